"""Queries over sequences ``(seq_id, pos, val)``, many at a time.

Every operator takes a table of queries with ``qid`` and ``seq_id`` and returns
one row a query (top-k: several): qid and the answer.  Positions start at 0,
ranges are ``[start, end)``, occurrence numbers of :func:`select` start at 1 and
``k`` of :func:`quantile` at 0.  What is not there is null.  With ``strict``
(the default) ranges outside their sequence fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.blocks import BLOCK, check_ranges, range_values, sizes


def size(s: DataFrame) -> DataFrame:
    """``(seq_id, size)``."""
    return sizes(s)


def access(s: DataFrame, q: DataFrame) -> DataFrame:
    """``q(qid, seq_id, k)`` to the value at position k."""
    return q.join(s.withColumnRenamed("pos", "k"), ["seq_id", "k"], "left").select("qid", F.col("val").alias("value"))


def _occurrences(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``__occ``, the number of the occurrence of its value, from 1.

    Counts of blocks come first, so that a value which fills a third of a
    sequence is numbered block by block.
    """
    s = s.withColumn("__block", F.floor(F.col("pos") / block))
    counts = s.groupBy("seq_id", "val", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("seq_id", "val").orderBy("__block")) - F.col("__n")
    starts = counts.select("seq_id", "val", "__block", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("seq_id", "val", "__block").orderBy("pos"))
    return s.withColumn("__in", inside).join(starts, ["seq_id", "val", "__block"]).withColumn("__occ", F.col("__before") + F.col("__in")).drop("__before", "__in", "__block")


def rank(s: DataFrame, q: DataFrame, block: int = BLOCK) -> DataFrame:
    """``q(qid, seq_id, k, value)`` to the number of ``value`` in ``[0, k)``.

    Full blocks before k through running counts, the rest through k's block.
    Queries meet the running counts by block, so a window holds a value's blocks
    only, however many queries ask for it.
    """
    s = s.withColumn("__block", F.floor(F.col("pos") / block))
    q = q.select("qid", "seq_id", F.col("value").alias("val"), F.col("k").cast("long").alias("k")).withColumn("__block", F.floor(F.col("k") / block))
    counts = s.groupBy("seq_id", "val", "__block").agg(F.count(F.lit(1)).alias("__n"))
    asked = q.select("seq_id", "val", "__block").distinct()
    blocks = counts.unionByName(asked.withColumn("__n", F.lit(0).cast("long"))).groupBy("seq_id", "val", "__block").agg(F.sum("__n").alias("__n"))
    running = F.sum("__n").over(Window.partitionBy("seq_id", "val").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    before = blocks.select("seq_id", "val", "__block", F.coalesce(running, F.lit(0)).alias("__before"))
    inside = q.join(s.select("seq_id", "val", "__block", "pos"), ["seq_id", "val", "__block"]).filter("pos < k").groupBy("qid").agg(F.count(F.lit(1)).alias("__in"))
    placed = q.join(before, ["seq_id", "val", "__block"], "left").select("qid", F.coalesce("__before", F.lit(0)).alias("__before"))
    return placed.join(inside, "qid", "left").select("qid", (F.col("__before") + F.coalesce("__in", F.lit(0))).alias("rank"))


def select(s: DataFrame, q: DataFrame) -> DataFrame:
    """``q(qid, seq_id, k, value)`` to the position of the k-th ``value`` (from 1)."""
    q = q.select("qid", "seq_id", F.col("value").alias("val"), F.col("k").cast("long").alias("__occ"))
    return q.join(_occurrences(s), ["seq_id", "val", "__occ"], "left").select("qid", F.col("pos").alias("position"))


def _ranges(s: DataFrame, q: DataFrame, strict: bool) -> DataFrame:
    return check_ranges(q, sizes(s)) if strict else q


def whole_range(s: DataFrame, q: DataFrame) -> DataFrame:
    """Gives queries without a range their whole sequence's."""
    return q.join(sizes(s), "seq_id").withColumn("start", F.lit(0).cast("long")).withColumnRenamed("size", "end")


def range_count(s: DataFrame, q: DataFrame, strict: bool = True) -> DataFrame:
    """``q(…, start, end, value)`` to how often ``value`` occurs there."""
    q = _ranges(s, q, strict)
    hits = range_values(s, q, F.col("val") == F.col("value")).groupBy("qid").agg(F.sum("cnt").alias("n"))
    return q.join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("count"))


def range_freq(s: DataFrame, q: DataFrame, strict: bool = True) -> DataFrame:
    """``q(…, start, end, min_value, max_value)`` to the number of elements with
    ``min_value <= val < max_value`` (0 for an empty interval)."""
    q = _ranges(s, q, strict)
    hits = range_values(s, q, (F.col("val") >= F.col("min_value")) & (F.col("val") < F.col("max_value"))).groupBy("qid").agg(F.sum("cnt").alias("n"))
    return q.join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("count"))


def _histogram(s: DataFrame, q: DataFrame) -> DataFrame:
    return range_values(s, q).groupBy("qid", "val").agg(F.sum("cnt").alias("cnt"))


def quantile(s: DataFrame, q: DataFrame, strict: bool = True) -> DataFrame:
    """``q(…, start, end, k)`` to the k-th smallest value there (from 0, duplicates counted)."""
    q = _ranges(s, q, strict)
    upto = F.sum("cnt").over(Window.partitionBy("qid").orderBy("val"))
    found = _histogram(s, q).withColumn("__upto", upto).join(q.select("qid", "k"), "qid").filter((F.col("__upto") > F.col("k")) & (F.col("k") >= 0))
    return q.select("qid").join(found.groupBy("qid").agg(F.min("val").alias("value")), "qid", "left")


def top_k(s: DataFrame, q: DataFrame, strict: bool = True) -> DataFrame:
    """``q(…, start, end, k)`` to at most k rows (value, frequency, place from 1):
    by falling frequency, then falling value."""
    q = _ranges(s, q, strict)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cnt"), F.desc("val")))
    ranked = _histogram(s, q).withColumn("place", place).join(q.select("qid", "k"), "qid").filter("place <= k")
    return ranked.select("qid", F.col("val").alias("value"), F.col("cnt").alias("frequency"), "place")


def range_mode(s: DataFrame, q: DataFrame, strict: bool = True) -> DataFrame:
    """The most frequent value of each range; of tied ones the largest."""
    q = _ranges(s, q, strict)
    best = _histogram(s, q).groupBy("qid").agg(F.max(F.struct("cnt", "val")).alias("m"))
    return best.select("qid", F.col("m.val").alias("value"), F.col("m.cnt").alias("frequency"))


def smaller_value(s: DataFrame, q: DataFrame, strict: bool = True, default=None) -> DataFrame:
    """``q(…, start, end, value)`` to the largest value below; ``found`` says whether
    there is one, else value is the default."""
    return _neighbour(s, q, strict, default, below=True)


def larger_value(s: DataFrame, q: DataFrame, strict: bool = True, default=None) -> DataFrame:
    """The smallest value above."""
    return _neighbour(s, q, strict, default, below=False)


def _neighbour(s: DataFrame, q: DataFrame, strict: bool, default, below: bool) -> DataFrame:
    q = _ranges(s, q, strict)
    near = range_values(s, q, F.col("val") < F.col("value") if below else F.col("val") > F.col("value"))
    best = near.groupBy("qid").agg((F.max("val") if below else F.min("val")).alias("near"))
    value = F.col("near") if default is None else F.coalesce(F.col("near"), F.lit(default).cast(s.schema["val"].dataType))
    return q.select("qid").join(best, "qid", "left").select("qid", value.alias("value"), F.col("near").isNotNull().alias("found"))
