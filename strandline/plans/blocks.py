"""Batched range queries as equi-joins on blocks of positions.

A query over ``[start, end)`` meets full blocks of the sequence through their
partial aggregates and only its two edge blocks through single rows, so a range
over the whole sequence costs as many rows as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 4096


def check_ranges(q: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fails on a range that is empty or leaves its sequence."""
    said = F.concat(F.lit("range ["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit(") is not inside its sequence"))
    bad = (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.coalesce(F.col("__n"), F.lit(0)))
    checked = q.join(sizes.select("seq_id", F.col("size").alias("__n")), "seq_id", "left")
    return checked.withColumn("start", F.when(bad, F.raise_error(said).cast("long")).otherwise(F.col("start"))).drop("__n")


def sizes(s: DataFrame) -> DataFrame:
    return s.groupBy("seq_id").agg(F.count(F.lit(1)).alias("size"))


def edge_rows(s: DataFrame, q: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of the sequence that queries reach outside full blocks, by ``qid``."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    whole_first, whole_last = F.col("start") % block == 0, F.col("end") % block == 0
    edges = F.array_distinct(F.filter(F.array(F.when(~whole_first | ((first == last) & ~whole_last), first), F.when(~whole_last, last)), lambda x: x.isNotNull()))
    asked = q.select("qid", "seq_id", "start", "end", F.explode(edges).alias("__block"))
    rows = s.withColumn("__block", F.floor(F.col("pos") / block))
    met = rows.join(asked, ["seq_id", "__block"])
    return met.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).drop("__block", "start", "end", "seq_id")


def full_blocks(q: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(qid, seq_id, __block)`` of the blocks that lie wholly in a query's range."""
    first, end = F.ceil(F.col("start") / block), F.floor(F.col("end") / block)
    return q.filter(first < end).select("qid", "seq_id", F.explode(F.sequence(first, end - 1)).alias("__block"))


def range_values(s: DataFrame, q: DataFrame, keep: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``(qid, val, cnt)``: the multiset of values in every query's range, in
    parts.  ``keep`` (over val and the queries' columns) is applied early."""
    extra = [c for c in q.columns if c not in ("seq_id", "start", "end", "qid")]
    single = edge_rows(s, q, block).select("qid", "val", F.lit(1).cast("long").alias("cnt"))
    partial = s.groupBy("seq_id", F.floor(F.col("pos") / block).alias("__block"), "val").agg(F.count(F.lit(1)).alias("cnt"))
    blocks = full_blocks(q, block).join(partial, ["seq_id", "__block"]).select("qid", "val", "cnt")
    out = single.union(blocks)
    if keep is not None:
        out = out.join(q.select("qid", *extra), "qid").filter(keep).select("qid", "val", "cnt")
    return out
