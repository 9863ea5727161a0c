"""Ranges of positions and values: the bits of values, level by level, as a table.

Values are replaced by their numbers in order.  At level l the elements stand in the
order of the l highest bits of their numbers, the latest bit first, and each
has its next bit; 63 of these bits and the zeros before them are one row.  How many
elements of a range have a zero there, and where they stand at the next level, is
told by the rows of the range's two ends.  So a query meets two rows a level, and
there are as many levels as the numbers have bits, however many values a range holds.

The k most frequent values are sought best first: a dive keeps the k fullest halves of
every level and ends at k values, whose last is a bound.  A second descent keeps all
halves that may hold a value before it in order; so a frequent value leaves few, and
only ranges of nearly equal frequencies are opened whole.

A table is built by one sort of all elements at all levels, dealt out by ranges,
and is then kept: :class:`ValueIndex` is saved and loaded with its checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.blocks import check_ranges
from strandline.plans.ranking import global_positions
from strandline.plans.suffix_order import sums_before
from strandline.plans.tables import write_table
from strandline.sources import store

KIND = "values"
#: Bits of a row; one less than a long integer has, so that masks do not overflow.
WORD = 63
#: Parts of a query's values that are ranked on their own before they meet.
PARTS = 64


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _met(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the sequences.  Neither may go through the driver: a
    sorted table's compressed file is small enough to be sent whole with millions of rows."""
    return one.join(other.hint("merge"), on, how)


@dataclass
class ValueIndex:
    """``words(seq_id, level, word, bits, zeros)``, ``sizes(seq_id, size)``, and ``codes(seq_id,
    val, code)``; ``depth`` levels."""

    words: DataFrame
    sizes: DataFrame
    codes: DataFrame
    depth: int

    @classmethod
    def build(cls, s: DataFrame) -> ValueIndex:
        """The index of ``s(seq_id, pos, val)``, without null values."""
        size = write_table(s.groupBy("seq_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
        numbered = write_table(global_positions(s.select("seq_id", "val").distinct(), ["seq_id", "val"], "g"), "values")
        first = numbered.groupBy("seq_id").agg(F.min("g").alias("first"))
        codes = write_table(_met(numbered, first, "seq_id").select("seq_id", "val", (F.col("g") - F.col("first")).alias("code")), "codes")
        depth = max(1, int(codes.agg(F.max("code")).first()[0] or 0).bit_length())
        turned = F.conv(F.reverse(F.lpad(F.bin("code"), depth, "0")), 2, 10).cast("long")
        rows = _met(s, codes.select("seq_id", "val", turned.alias("turned")), ["seq_id", "val"]).select("seq_id", "pos", "turned", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
        mask = _shift("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1
        rows = rows.select("seq_id", "level", F.col("turned").bitwiseAND(mask).alias("key"), "pos", _shift("shiftright", F.col("turned"), F.col("level")).bitwiseAND(F.lit(1).cast("long")).alias("bit"))
        placed = global_positions(rows, ["seq_id", "level", "key", "pos"], "g", keep=["seq_id", "level", "bit"])
        base = placed.groupBy("seq_id", "level").agg(F.min("g").alias("base"))
        at = F.col("g") - F.col("base")
        packed = _met(placed, base, ["seq_id", "level"]).select("seq_id", "level", F.floor(at / WORD).alias("word"), _shift("shiftleft", F.col("bit"), at % WORD).alias("bit"), (1 - F.col("bit")).alias("zero"))
        words = packed.groupBy("seq_id", "level", "word").agg(F.bit_or("bit").alias("bits"), F.sum("zero").alias("n"))
        # a range may end where a word begins: there is one more word behind full ones
        behind = size.filter(F.col("size") % WORD == 0).select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"), F.floor(F.col("size") / WORD).alias("word"), F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("n"))
        summed = write_table(sums_before(words.unionByName(behind), ["seq_id", "level", "word"]), "words")
        start = summed.groupBy("seq_id", "level").agg(F.min("s").alias("start"), F.sum("n").alias("all"))
        out = _met(summed, start, ["seq_id", "level"]).select("seq_id", "level", "word", "bits", (F.col("s") - F.col("start")).alias("zeros"), F.col("all").alias("level_zeros"))
        return cls(write_table(out, "value-words"), size, codes, depth)

    def save(self, path: str) -> None:
        settings = self.words.sparkSession.createDataFrame([(self.depth,)], "depth int")
        store.save({"words": self.words, "sizes": self.sizes, "codes": self.codes, "settings": settings}, path, KIND)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ValueIndex:
        parts = store.load(spark, path, KIND)
        return cls(parts["words"], parts["sizes"], parts["codes"], parts["settings"].first()[0])

    # --- one level after another -----------------------------------------------

    def _zeros(self, rows: DataFrame, level: int, at: str) -> DataFrame:
        """Adds ``__z_at``, the zeros before a position of a level: one row of the table."""
        own = self.words.filter(F.col("level") == level).select("seq_id", F.col("word").alias("__word"), "bits", "zeros", F.col("level_zeros").alias(f"__all_{at}"))
        rows = _met(rows.withColumn("__word", F.floor(F.col(at) / WORD)), own, ["seq_id", "__word"])
        low = F.col("bits").bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), F.col(at) % WORD) - 1)
        return rows.withColumn(f"__z_{at}", F.col("zeros") + F.col(at) % WORD - F.bit_count(low)).drop("__word", "bits", "zeros")

    def _step(self, rows: DataFrame, level: int, high: Column, **more: Column) -> DataFrame:
        """The ranges ``[lo, hi)`` of the next level, those of ones where ``high`` holds;
        both may use ``__in``, the zeros of the range."""
        rows = self._zeros(self._zeros(rows, level, "lo"), level, "hi").withColumn("__in", F.col("__z_hi") - F.col("__z_lo"))
        moved = rows.withColumn("__high", high)
        for name, value in more.items():
            moved = moved.withColumn(name, value)
        for c in ("lo", "hi"):
            moved = moved.withColumn(c, F.when(F.col("__high"), F.col(f"__all_{c}") + F.col(c) - F.col(f"__z_{c}")).otherwise(F.col(f"__z_{c}")))
        return moved.drop("__z_lo", "__z_hi", "__all_lo", "__all_hi", "__in", "__high")

    def _asked(self, q: DataFrame, strict: bool) -> DataFrame:
        return check_ranges(q, self.sizes.hint("merge")) if strict else q

    def _kth(self, rows: DataFrame) -> DataFrame:
        """``rows(qid, seq_id, lo, hi, k)`` to ``(qid, val)``; those with no such value go."""
        rows = rows.filter((F.col("k") >= 0) & (F.col("k") < F.col("hi") - F.col("lo"))).select("qid", "seq_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("code"))
        for level in range(self.depth):
            high = F.col("k") >= F.col("__in")
            k = F.when(F.col("__high"), F.col("k") - F.col("__in")).otherwise(F.col("k"))
            rows = self._step(rows, level, high, k=k, code=F.col("code") * 2 + F.col("__high").cast("long"))
            if level % 6 == 5:
                rows = write_table(rows, "descent")
        return _met(rows.select("qid", "seq_id", "code"), self.codes, ["seq_id", "code"]).select("qid", "val")

    def _below(self, q: DataFrame, value: str, name: str, through: bool = False) -> DataFrame:
        """``q(qid, seq_id, start, end, value)`` with ``name``, the elements of the range below
        the value (``through``: and those that equal it)."""
        asked = q.filter(F.col(value).isNotNull()).select("seq_id", F.col(value).cast(self.codes.schema["val"].dataType).alias("val"), F.lit(0).cast("long").alias("n"))
        merged = self.codes.select("seq_id", "val", F.lit(1).cast("long").alias("n")).unionByName(asked).groupBy("seq_id", "val").agg(F.sum("n").alias("n"))
        before = write_table(sums_before(merged, ["seq_id", "val"]), "codes-before")
        base = before.groupBy("seq_id").agg(F.min("s").alias("base"))
        own = F.col("n") if through else F.lit(0)
        bound = _met(before, base, "seq_id").select("seq_id", F.col("val").alias(value), (F.col("s") - F.col("base") + own).alias("code"))
        rows = _met(q, bound, ["seq_id", value]).select("qid", "seq_id", F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), "code", F.lit(0).cast("long").alias("below"))
        past = rows.filter(F.col("code") >= 1 << self.depth).select("qid", (F.col("hi") - F.col("lo")).alias(name))
        rows = rows.filter(F.col("code") < 1 << self.depth)
        for level in range(self.depth):
            high = F.col("code").bitwiseAND(F.lit(1 << (self.depth - 1 - level)).cast("long")) != 0
            rows = self._step(rows, level, high, below=F.col("below") + F.when(F.col("__high"), F.col("__in")).otherwise(F.lit(0)))
            if level % 6 == 5:
                rows = write_table(rows, "descent")
        return _met(q, rows.select("qid", F.col("below").alias(name)).unionByName(past), "qid", "left")

    def _halves(self, rows: DataFrame, level: int) -> DataFrame:
        """``rows(…, lo, hi, code)`` to both halves of their values at the next level, if they
        hold any element."""
        keep = [c for c in rows.columns if c not in ("lo", "hi", "code")]
        met = self._zeros(self._zeros(rows, level, "lo"), level, "hi")
        zero = F.struct(F.col("__z_lo").alias("lo"), F.col("__z_hi").alias("hi"), (F.col("code") * 2).alias("code"))
        ones = [(F.col(f"__all_{c}") + F.col(c) - F.col(f"__z_{c}")).alias(c) for c in ("lo", "hi")]
        one = F.struct(*ones, (F.col("code") * 2 + 1).alias("code"))
        return met.select(*keep, F.explode(F.array(zero, one)).alias("__half")).select(*keep, "__half.*").filter("lo < hi")

    def _fullest(self, rows: DataFrame, *part: Column) -> DataFrame:
        """The k rows of each query with most elements, of equal ones those of larger values."""
        place = F.row_number().over(Window.partitionBy("qid", *part).orderBy(F.desc(F.col("hi") - F.col("lo")), F.desc("code")))
        return rows.withColumn("place", place).filter("place <= k")

    def _most_frequent(self, q: DataFrame) -> DataFrame:
        """``q(qid, seq_id, start, end, k)`` to ``(qid, seq_id, code, frequency, place)``."""
        whole = q.filter("k > 0").select("qid", "seq_id", F.col("k").cast("long").alias("k"), F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), F.lit(0).cast("long").alias("code")).filter("lo < hi")
        dive = whole = write_table(whole, "ranges")
        for level in range(self.depth):
            dive = self._fullest(self._halves(dive, level)).drop("place")
            if level % 4 == 3:
                dive = write_table(dive, "dive")
        last = F.min(F.struct((F.col("hi") - F.col("lo")).alias("n"), "code")).alias("last")
        bound = dive.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("have"), last).filter("have = k").select("qid", F.col("last.n").alias("least"), F.col("last.code").alias("least_code"))
        rows = _met(whole, write_table(bound, "bounds"), "qid", "left")
        for level in range(self.depth):
            rows = self._halves(rows, level)
            n, left = F.col("hi") - F.col("lo"), self.depth - 1 - level
            largest = (F.col("code") + 1) * (1 << left) - 1
            before = (n > F.col("least")) | ((n == F.col("least")) & (largest >= F.col("least_code")))
            rows = rows.filter(F.col("least").isNull() | before)
            if level % 4 == 3:
                rows = write_table(rows, "descent")
        some = self._fullest(rows, F.pmod(F.xxhash64("code"), F.lit(PARTS)))
        return self._fullest(some).select("qid", "seq_id", "code", (F.col("hi") - F.col("lo")).alias("frequency"), "place")

    # --- queries, as those of strandline.operators.sequence ------------------------

    def quantile(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(qid, seq_id, start, end, k)`` to the k-th smallest value (from 0)."""
        q = self._asked(q, strict)
        found = self._kth(q.select("qid", "seq_id", F.col("start").alias("lo"), F.col("end").alias("hi"), "k"))
        return _met(q.select("qid"), found, "qid", "left").select("qid", F.col("val").alias("value"))

    def range_freq(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(…, start, end, min_value, max_value)`` to the elements between."""
        q = self._asked(q, strict).select("qid", "seq_id", "start", "end", "min_value", "max_value")
        both = self._below(self._below(q, "min_value", "__lo"), "max_value", "__hi")
        return both.select("qid", F.greatest(F.coalesce(F.col("__hi") - F.col("__lo"), F.lit(0)), F.lit(0)).alias("count"))

    def smaller_value(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(…, start, end, value)`` to the largest value below, and ``found``."""
        q = self._asked(q, strict).select("qid", "seq_id", "start", "end", "value")
        rows = self._below(q, "value", "__n").select("qid", "seq_id", F.col("start").alias("lo"), F.col("end").alias("hi"), (F.col("__n") - 1).alias("k"))
        found = self._kth(rows)
        return _met(q.select("qid"), found, "qid", "left").select("qid", F.col("val").alias("value"), F.col("val").isNotNull().alias("found"))

    def larger_value(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(…, start, end, value)`` to the smallest value above, and ``found``."""
        q = self._asked(q, strict).select("qid", "seq_id", "start", "end", "value")
        rows = self._below(q, "value", "__n", through=True).select("qid", "seq_id", F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("__n").alias("k"))
        found = self._kth(rows)
        return _met(q.select("qid"), found, "qid", "left").select("qid", F.col("val").alias("value"), F.col("val").isNotNull().alias("found"))

    def top_k(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(…, start, end, k)`` to at most k rows (value, frequency, place from 1): by
        falling frequency, then falling value; none for an empty range or a k below 1."""
        found = self._most_frequent(self._asked(q, strict).select("qid", "seq_id", "start", "end", "k"))
        return _met(found, self.codes, ["seq_id", "code"]).select("qid", F.col("val").alias("value"), "frequency", "place")

    def range_mode(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """The most frequent value of each range that is not empty; of tied ones the largest."""
        one = self._asked(q, strict).select("qid", "seq_id", "start", "end", F.lit(1).alias("k"))
        return _met(self._most_frequent(one), self.codes, ["seq_id", "code"]).select("qid", F.col("val").alias("value"), "frequency")
