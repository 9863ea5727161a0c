"""Suffixes of any amount of text in order, by prefix doubling with discarding.

As many characters as fit a number are packed at every position and ranked at
once: a rank is the number of suffixes before, so it stays when later ones are told
apart.  Suffixes that are alone with their rank are done and leave; those that are
tied take the rank of the suffix ``k`` further on and are told apart by it, and
``k`` doubles.  A round moves the tied suffixes, and of the ranks that are done those
that they ask for.  Groups of tied suffixes are counted before anything is sorted, and
sorted by ranges, so a group may hold most suffixes.

Every round's tied suffixes are kept: the common prefix of two suffixes is the sum of
the lengths at which they are tied, from the longest down, and what is left is
read from the packed characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.plans.tables import drop_table, write_table

#: Positions that a worker hands over at a time.
_CHUNK = 1 << 16


@dataclass
class SuffixOrder:
    """``ranks(at, pos, r)`` of all suffixes; equal ones of different texts share one.
    ``tied`` has for each round the characters that tied suffixes have in common and
    ``(at, pos, r, left)`` of those suffixes; ``codes(at, pos, code, left)`` the packed
    characters, ``width`` of them with ``bits`` each, as numbers in ``alphabet`` from 1 on;
    ``left`` counts those to the end."""

    ranks: DataFrame
    codes: DataFrame
    width: int
    bits: int
    alphabet: list[int]
    tied: list[tuple[int, DataFrame]] = field(default_factory=list)

    def common_prefixes(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with columns (at1, pos1, at2, pos2) with ``lcp`` of different suffixes."""
        columns = pairs.columns
        rows = pairs.withColumn("lcp", F.lit(0).cast("long"))

        def met(rows: DataFrame, table: DataFrame, value: str) -> DataFrame:
            for n in ("1", "2"):
                side = table.select(F.col("at").alias(f"at{n}"), F.col("pos").alias(f"__p{n}"), F.col(value).alias(f"__v{n}"), F.col("left").alias(f"__l{n}"))
                rows = rows.withColumn(f"__p{n}", F.col(f"pos{n}") + F.col("lcp")).join(side, [f"at{n}", f"__p{n}"], "left")
            return rows

        for size, table in reversed(self.tied):
            both = met(rows, table, "r")
            more = F.when(F.col("__v1") == F.col("__v2"), F.least(F.lit(size), "__l1", "__l2")).otherwise(F.lit(0))
            rows = write_table(both.withColumn("lcp", F.col("lcp") + more).select(*columns, "lcp"), "prefixes")
        both = met(rows, self.codes, "code")
        differ = F.col("__v1").bitwiseXOR(F.col("__v2"))
        # the first character that differs, from the highest bit that does
        zeros = F.lit(64) - F.length(F.regexp_replace(F.bin(differ), "^0+", ""))
        equal = F.floor((zeros - (64 - self.width * self.bits)) / self.bits)
        more = F.least(F.when(differ == 0, F.lit(self.width)).otherwise(equal), "__l1", "__l2")
        # a suffix that ended has no characters left
        return both.withColumn("lcp", F.col("lcp") + F.when(differ.isNotNull(), more).otherwise(F.lit(0))).select(*columns, F.col("lcp").cast("int").alias("lcp"))


def sums_before(groups: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``s``, the sum of ``n`` over all groups before, in the given order: sums of
    range partitions, one number each, are the driver's part."""
    dealt = groups.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    table = write_table(dealt, "groups")
    sums = {r[0]: r[1] for r in table.groupBy("__part").agg(F.sum("n")).collect()}
    offsets, at = [], 0
    for part in sorted(sums):
        offsets.append((part, at))
        at += sums[part]
    base = groups.sparkSession.createDataFrame(offsets, "__part int, __base long")
    inside = F.sum("n").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return table.join(F.broadcast(base), "__part").withColumn("s", F.col("__base") + inside).drop("__part", "__base")


def _packed(texts: DataFrame) -> tuple[DataFrame, int, int, list[int]]:
    """``(at, pos, code, left)``, the characters of a code, their bits, and the alphabet."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(kernels.code_points(text)), pa.int32())], names=["c"])

    # no more rows than there are code points
    alphabet = np.array(sorted(r[0] for r in texts.select("text").mapInArrow(used, "c int").distinct().collect()), np.int32)
    bits = max(1, len(alphabet).bit_length())
    width = 62 // bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = kernels.code_points(text)
                for lo in range(0, len(codes), _CHUNK):
                    part = np.searchsorted(alphabet, codes[lo : lo + _CHUNK + width]).astype(np.int64) + 1  # an end is 0
                    n = min(_CHUNK, len(codes) - lo)
                    padded = np.concatenate([part, np.zeros(width, np.int64)])
                    key = np.zeros(n, np.int64)
                    for i in range(width):
                        key = key << bits | padded[i : i + n]
                    pos = np.arange(lo, lo + n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(pos, pa.int64()), pa.array(key), pa.array(len(codes) - pos, pa.int64())], names=["at", "pos", "code", "left"])

    return write_table(texts.select("at", "text").mapInArrow(pack, "at long, pos long, code long, left long"), "codes"), width, bits, alphabet.tolist()


def suffix_order(texts: DataFrame, apart: bool) -> SuffixOrder:
    """The order of all suffixes of ``texts(at, text)``: all together, or with ``apart``
    text by text (ranks go on from one text to the next)."""
    codes, width, bits, alphabet = _packed(texts)
    order = ["at", "code"] if apart else ["code"]
    groups = sums_before(codes.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), order)
    ranked = write_table(codes.join(groups, order).select("at", "pos", F.col("s").alias("r"), "n", "left"), "ranks")
    drop_table(groups)
    out = SuffixOrder(ranked, codes, width, bits, alphabet)
    done, k = [ranked.filter(F.col("n") == 1)], width
    while True:
        tied = ranked.filter("n > 1")
        out.tied.append((k, tied.select("at", "pos", "r", "left")))
        # suffixes that end within what is compared are equal: they stay tied
        ended, open_ = tied.filter(F.col("left") <= k), tied.filter(F.col("left") > k)
        done.append(ended)
        if open_.isEmpty():
            break
        known = [t.select("at", "pos", F.col("r").alias("ahead")) for t in (*done, open_)]
        ahead = known[0]
        for t in known[1:]:
            ahead = ahead.union(t)
        asked = open_.select("at", F.col("pos").alias("own"), (F.col("pos") + k).alias("pos"), "r", "left")
        pairs = write_table(asked.join(ahead, ["at", "pos"]).select("at", F.col("own").alias("pos"), "r", "left", "ahead"), "pairs")
        groups = sums_before(pairs.groupBy("r", "ahead").agg(F.count(F.lit(1)).alias("n")), ["r", "ahead"])
        first = groups.groupBy("r").agg(F.min("s").alias("first"))
        # equal suffixes that ended come before those that go on, and are part of the group
        before = ended.groupBy("r").agg(F.count(F.lit(1)).alias("ended"))
        named = groups.join(first, "r").join(before, "r", "left")
        named = named.select("r", "ahead", "n", (F.col("r") + F.coalesce("ended", F.lit(0)) + F.col("s") - F.col("first")).alias("new"))
        ranked = write_table(pairs.join(named, ["r", "ahead"]).select("at", "pos", F.col("new").alias("r"), "n", "left"), "ranks")
        for used in (pairs, groups):
            drop_table(used)
        done.append(ranked.filter(F.col("n") == 1))
        k *= 2
    ranks = done[0]
    for t in done[1:]:
        ranks = ranks.union(t)
    out.ranks = ranks.select("at", "pos", "r")
    return out
