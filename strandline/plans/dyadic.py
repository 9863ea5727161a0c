"""Aggregates of blocks at all powers of two: ranges in a logarithm of rows.

A node ``(level, node)`` of a sequence covers its blocks from ``node * 2**level`` on, so
many as ``2**level``.  Any run of blocks is made of at most two nodes a level, and a
query explodes to those, which it meets in one equi-join.  Each block's aggregate
is added to its node of every level in one grouping, with partial sums before its
shuffle: for n positions in blocks of B these are n / B times log(n / B) rows.

Nodes carry ``at``, the first block they have, for merges that depend on order.
Rows of the same node are parts of it, so a kept table grows by further rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From rows (keys, at, state) to one row a key with the least ``at`` and the states merged.
Combine = Callable[[DataFrame, list[str]], DataFrame]

NODE = ["seq_id", "level", "node"]


def by_aggregate(merge: Callable[[Column], Column]) -> Combine:
    """A merge that is an aggregate function of states, in any order."""
    return lambda df, keys: df.groupBy(*keys).agg(F.min("at").alias("at"), merge(F.col("state")).alias("state"))


def by_fold(merge: Callable[[Column, Column], Column]) -> Combine:
    """A merge of two states at a time, from left to right."""

    def combine(df: DataFrame, keys: list[str]) -> DataFrame:
        parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "state"))).alias("a"))
        states = F.transform("a", lambda x: x["state"])
        rest = F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0)))
        return parts.select(*keys, F.get("a", F.lit(0))["at"].alias("at"), F.aggregate(rest, states[0], merge).alias("state"))

    return combine


def _half(x: Column, times: Column) -> Column:
    return F.call_function("shiftright", x, times.cast("int"))


def depth(blocks: Column) -> Column:
    """The level at which one node has so many blocks."""
    return F.when(blocks > 1, F.length(F.bin(blocks - 1))).otherwise(0)


def nodes(blocks: DataFrame, sizes: DataFrame, combine: Combine, block: int) -> DataFrame:
    """``blocks(seq_id, at, state)``, one row a block, to the nodes of all levels;
    ``sizes(seq_id, size)`` in positions."""
    levels = F.sequence(F.lit(0), depth(F.ceil(F.col("size") / block)))
    rows = blocks.join(sizes, "seq_id").select("seq_id", "at", "state", F.explode(levels).alias("level"))
    return combine(rows.withColumn("node", _half(F.col("at"), F.col("level"))), NODE)


def pieces(q: DataFrame, block: int) -> DataFrame:
    """``q(qid, seq_id, start, end)`` to ``(qid, seq_id, level, node)``: the nodes that make up
    the blocks which lie wholly inside, at most two a level."""
    first, last = F.ceil(F.col("start") / block), F.floor(F.col("end") / block)

    def taken(level: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        lo, hi = _half(first + one - 1, level), _half(last, level)
        odd = lambda x: x % 2 == 1
        node = lambda x: F.struct(level.alias("level"), x.alias("node"))
        return F.array(F.when((lo < hi) & odd(lo), node(lo)), F.when((lo < hi) & odd(hi), node(hi - 1)))

    found = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(last))), taken)), lambda x: x.isNotNull())
    return q.filter(first < last).select("qid", "seq_id", F.explode(found).alias("__n")).select("qid", "seq_id", "__n.level", "__n.node")
