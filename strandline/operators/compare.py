"""What two texts have in common: ``pairs(pair_id, text1, text2)``.

A pair's suffixes stand in one table with their side; comparisons stop at each
text's end, so no separator character is reserved.  That table, ``px``, is keyed (see
:mod:`strandline.plans.keys`), so pairs with null or repeated ids stay apart.

Defined cases: a pair with a null text has no rows, nor have empty texts anything in
common; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators.repeats import INTERVAL, intervals
from strandline.operators.suffix import MAX_CHARS
from strandline.plans import asof
from strandline.plans.keys import is_keyed, keyed, unkeyed
from strandline.plans.ranking import global_positions
from strandline.plans.suffix_order import suffix_order
from strandline.plans.tables import write_table
from strandline.streaming.counts import grams

def keyed_pairs(pairs: DataFrame) -> DataFrame:
    return keyed(pairs, "pair_id", ("text1", "text2"))


def _suffix_order(text1: str, text2: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides, positions and common prefixes of both texts' suffixes in order."""
    one, two = kernels.code_points(text1), kernels.code_points(text2)
    # two ends below every character, different from each other
    order, lcp = kernels.suffix_order(np.concatenate([one, [-2], two, [-1]]).astype(np.int64))
    order, lcp = order[2:], lcp[2:].copy()  # the ends sort first
    lcp[:1] = 0
    side = np.where(order < len(one), 1, 2)
    return side, np.where(side == 1, order, order - len(one) - 1), lcp


def pair_suffixes(pairs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(pair_id, rank, side, pos, lcp)`` with side 1 or 2, keyed; operators that take
    ``pairs`` as well want those keyed before.  Pairs of more than ``max_chars``
    characters go through one order of all their suffixes."""
    pairs = keyed_pairs(pairs)
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (t1, t2) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                side, pos, lcp = _suffix_order(t1, t2)
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.full(n, i))), pa.array(np.arange(n), pa.int32()), pa.array(side, pa.int32()), pa.array(pos, pa.int32()), pa.array(lcp, pa.int32())], names=["pair_id", "rank", "side", "pos", "lcp"]
                )

    rows = pairs.select("pair_id", "text1", "text2").na.drop(subset=["text1", "text2"])
    size = F.length("text1") + F.length("text2")
    kept = rows.filter(size <= max_chars).mapInArrow(run, f"pair_id {kind}, rank int, side int, pos int, lcp int")
    giant = rows.filter(size > max_chars)
    return kept.union(_giant_suffixes(giant)) if giant.take(1) else kept


def _giant_suffixes(pairs: DataFrame) -> DataFrame:
    """The same rows for pairs of any length: both texts' suffixes in the order of all,
    numbered pair by pair, each compared with the one before it."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"text{n}").alias("text")) for n in (1, 2)]))
    texts = write_table(pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.*").filter("text <> ''").withColumn("at", F.monotonically_increasing_id()), "pair-texts")
    order = suffix_order(texts.select("at", "text"), apart=False)
    rows = order.ranks.join(texts.select("at", "pair_id", "side"), "at")
    # of two equal suffixes that of the first text comes first: its end is the lower one
    placed = write_table(global_positions(rows, ["pair_id", "r", "side", "pos"], "idx"), "pair-order")
    first = placed.groupBy("pair_id").agg(F.min("idx").alias("first"))
    ranked = write_table(placed.join(first, "pair_id").withColumn("rank", F.col("idx") - F.col("first")), "pair-ranks")
    before = asof.beside(ranked, ["pair_id"], "rank", ["at", "pos"], "__before", -1).filter("__before is not null")
    pairs_of = before.select("pair_id", "rank", "side", F.col("at").alias("at1"), F.col("pos").alias("pos1"), F.col("__before.at").alias("at2"), F.col("__before.pos").alias("pos2"))
    rest = order.common_prefixes(pairs_of).select("pair_id", "rank", "side", F.col("pos1").alias("pos"), "lcp")
    all_ = rest.unionByName(ranked.filter("rank = 0").select("pair_id", "rank", "side", "pos", F.lit(0).alias("lcp")))
    return all_.select("pair_id", F.col("rank").cast("int").alias("rank"), F.col("side").cast("int").alias("side"), F.col("pos").cast("int").alias("pos"), F.col("lcp").cast("int").alias("lcp"))


def _neighbours(px: DataFrame) -> DataFrame:
    """Suffixes whose predecessor belongs to the other text, with both positions."""
    rows = asof.beside(px, ["pair_id"], "rank", ["pos", "side"], "__before", -1).withColumn("__pos", F.col("__before.pos")).filter("__before.side <> side")
    one = F.when(F.col("side") == 1, F.col("pos")).otherwise(F.col("__pos"))
    two = F.when(F.col("side") == 1, F.col("__pos")).otherwise(F.col("pos"))
    return rows.select("pair_id", "rank", one.alias("position1"), two.alias("position2"), F.col("lcp").alias("length"))


def matches(px: DataFrame, min_length: int = 2) -> DataFrame:
    """``(pair_id, position1, position2, length)`` of neighbours in suffix order
    that come from different texts and share ``min_length`` characters or more."""
    return unkeyed(_neighbours(px).filter(F.col("length") >= min_length).drop("rank"), "pair_id")


def longest_match(px: DataFrame) -> DataFrame:
    """The longest of these, of equal ones the first in suffix order."""
    best = _neighbours(px).filter("length > 0").groupBy("pair_id").agg(F.max_by(F.struct("position1", "position2", "length"), F.struct(F.col("length"), -F.col("rank"))).alias("m"))
    return unkeyed(best.select("pair_id", "m.*"), "pair_id")


def _text_at(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    texts = pairs.select("pair_id", F.col("text1").alias("__t1"), F.col("text2").alias("__t2"))
    part = F.expr("substring(if(side = 1, __t1, __t2), pos + 1, len)")
    return rows.join(texts, "pair_id").withColumn("text", part).drop("__t1", "__t2")


def _with_suffixes(pairs: DataFrame, px: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if px is None:
        pairs = keyed_pairs(pairs)
        return pairs, pair_suffixes(pairs)
    if not is_keyed(pairs, "pair_id"):
        raise ValueError("suffixes go with keyed pairs: pairs = keyed_pairs(pairs), px = pair_suffixes(pairs)")
    return pairs, px


def longest_common(pairs: DataFrame, px: DataFrame | None = None) -> DataFrame:
    """``(pair_id, text, positions1, positions2)`` of all longest common substrings."""
    pairs, px = _with_suffixes(pairs, px)
    best = _neighbours(px).groupBy("pair_id").agg(F.max("length").alias("len")).filter("len > 0")
    rows = asof.running(px.join(best, "pair_id"), ["pair_id"], "rank", "pos", F.when(F.col("lcp") < F.col("len"), F.col("rank")), "run")
    # of a run with one suffix only nothing is shared
    return unkeyed(_both_sides(_text_at(rows, pairs), "run"), "pair_id")


def common_intervals(pairs: DataFrame, min_length: int = 2) -> DataFrame:
    """``(pair_id, position1, position2, shortest, longest, count1, count2)``: all common
    substrings of at least ``min_length`` in a table no longer than the texts; see
    :func:`strandline.operators.repeats.repeat_intervals`.  Here those intervals of
    suffixes stay that have both sides; positions are the first ones."""
    if min_length < 1:
        raise ValueError("min_length must be positive")
    kind = pairs.schema["pair_id"].dataType.simpleString()
    rows = pairs.select("pair_id", "text1", "text2").na.drop(subset=["text1", "text2"])
    found = rows.mapInArrow(lambda batches: intervals(batches, min_length, _suffix_order), f"key {kind}, " + ", ".join(f"{c} int" for c in INTERVAL))
    return found.filter("count1 > 0 and count2 > 0").withColumnRenamed("key", "pair_id")


def common_substrings(pairs: DataFrame, px: DataFrame | None = None, min_length: int = 2, max_length: int | None = None) -> DataFrame:
    """``(pair_id, text, positions1, positions2)`` of every distinct common substring of
    at least ``min_length``; grows with the square of their lengths."""
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    pairs, px = _with_suffixes(pairs, px)
    longest = F.greatest("lcp", F.coalesce("__next.lcp", F.lit(0)))
    if max_length is not None:
        longest = F.least(longest, F.lit(max_length))
    rows = asof.beside(px, ["pair_id"], "rank", ["lcp"], "__next", 1).withColumn("m", longest).filter(F.col("m") >= min_length).select("pair_id", "side", "pos", F.explode(F.sequence(F.lit(min_length), F.col("m"))).alias("len"))
    return unkeyed(_both_sides(_text_at(rows, pairs)), "pair_id")


def _both_sides(rows: DataFrame, *keys: str) -> DataFrame:
    at = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("pos"))))
    found = rows.groupBy("pair_id", *keys, "text").agg(at(1).alias("positions1"), at(2).alias("positions2"))
    return found.filter((F.size("positions1") > 0) & (F.size("positions2") > 0)).drop(*keys)


def common_grams(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``(doc_id1, doc_id2, text, position1, position2)``: all shared k-character
    grams of two corpora, an equi-join on the gram."""

    def side(df: DataFrame, n: int) -> DataFrame:
        return grams(df, k).withColumnsRenamed({"doc_id": f"doc_id{n}", "pos": f"position{n}"})

    return side(left, 1).join(side(right, 2), "gram").select("doc_id1", "doc_id2", F.col("gram").alias("text"), "position1", "position2")


def with_reverse(docs: DataFrame) -> DataFrame:
    """Pairs of every text and its reverse."""
    return docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("text1"), F.reverse("text").alias("text2"))


def longest_common_with_reverse(docs: DataFrame) -> DataFrame:
    """``(doc_id, position, length)``: the longest match of a text with its reverse,
    which need not be a palindrome."""
    return longest_match(pair_suffixes(with_reverse(docs))).select(F.col("pair_id").alias("doc_id"), F.col("position1").alias("position"), "length")
