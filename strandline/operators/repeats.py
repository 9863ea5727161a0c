"""Repeated and unique substrings, tandem repeats and complexity of texts.

``sx``, where it is given, is the suffix table of ``docs``, and both are keyed (see
:func:`strandline.operators.suffix.with_table`).  Without it the longest repeats and
the shortest unique substrings come from the texts, and no row a character is written;
only texts beyond ``suffix.MAX_CHARS`` get a suffix table.

Defined cases, of all operators: null and empty texts have no rows (an empty one's
complexity is 0); rows with null or repeated ids are texts of their own; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators import suffix
from strandline.plans import asof, tables
from strandline.plans.keys import by_row, is_keyed, unkeyed


def _next_lcp(sx: DataFrame) -> DataFrame:
    """Adds ``next``, the common prefix with the suffix behind; 0 for the last one."""
    return asof.beside(sx, ["doc_id"], "rank", ["lcp"], "__next", 1).withColumn("next", F.coalesce("__next.lcp", F.lit(0))).drop("__next")


def _substring(sx: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``text``, the ``len`` characters at ``pos``."""
    chars = docs.select("doc_id", F.col("text").alias("__text"))
    return sx.join(chars, "doc_id").withColumn("text", F.expr("substring(__text, pos + 1, len)")).drop("__text")


def _with_table(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators on keyed texts and their suffix table: makes what is not given,
    and puts the caller's ids back."""

    @wraps(f)
    def run(docs: DataFrame, sx: DataFrame | None = None, *args, **options) -> DataFrame:
        out = f(*suffix.with_table(docs, sx), *args, **options)
        return out if is_keyed(docs) else unkeyed(out)

    return run


def _from_texts(schema: str, kinds: list[tuple[str, pa.DataType]], find: Callable[[str], list[tuple]]) -> Callable:
    """For operators whose rows of one text a kernel finds: texts that come without a
    suffix table go through it, those beyond ``max_chars`` through their table."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        by_table = _with_table(f)

        @wraps(f)
        def run(docs: DataFrame, sx: DataFrame | None = None, max_chars: int = suffix.MAX_CHARS) -> DataFrame:
            if sx is not None:
                return by_table(docs, sx)
            texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
            kept = _per_text(texts.filter(F.length("text") <= max_chars), schema, kinds, find)
            giant = texts.filter(F.length("text") > max_chars)
            return kept.union(by_table(giant)) if giant.take(1) else kept

        return run

    return wrap


@_with_table
def find_repeats(docs: DataFrame, sx: DataFrame, min_length: int = 2, max_length: int | None = None) -> DataFrame:
    """``(doc_id, text, positions)`` of every distinct substring of at least
    ``min_length`` that occurs twice or more.  The output grows with the square
    of repeats' lengths; ``max_length`` bounds it."""
    if min_length < 1:
        raise ValueError("min_length must be positive")
    longest = F.greatest("lcp", "next")
    if max_length is not None:
        longest = F.least(longest, F.lit(max_length))
    rows = _next_lcp(sx).withColumn("m", longest).filter(F.col("m") >= min_length).select("doc_id", "pos", F.explode(F.sequence(F.lit(min_length), F.col("m"))).alias("len"))
    return _substring(rows, docs).groupBy("doc_id", "text").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def search_repeated(docs: DataFrame, sx: DataFrame | None = None, min_length: int = 2) -> DataFrame:
    """As :func:`find_repeats`, for lengths from two on."""
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    return find_repeats(docs, sx, min_length)


def _longest(text: str) -> list[tuple[str, list[int]]]:
    size, places = kernels.longest_repeats(kernels.code_points(text))
    return [(text[p[0] : p[0] + size], p.tolist()) for p in places]


_REPEATED = ("text string, positions array<int>", [("text", pa.string()), ("positions", pa.list_(pa.int32()))])


@_from_texts(*_REPEATED, _longest)
def longest_repeated(docs: DataFrame, sx: DataFrame) -> DataFrame:
    """``(doc_id, text, positions)`` of all repeated substrings of the greatest
    length; texts without a repeat have no row.

    Suffixes that share them are neighbours: runs of ranks whose lcp is the
    maximum."""
    best = sx.groupBy("doc_id").agg(F.max("lcp").alias("len")).filter("len > 0")
    rows = asof.running(sx.join(best, "doc_id"), ["doc_id"], "rank", "pos", F.when(F.col("lcp") < F.col("len"), F.col("rank")), "run")
    runs = rows.groupBy("doc_id", "run", "len").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.min("pos").alias("pos")).filter(F.size("positions") > 1)
    return _substring(runs, docs).select("doc_id", "text", "positions")


@_from_texts(*_REPEATED, lambda text: _longest(text)[:1])
def longest_repeat(docs: DataFrame, sx: DataFrame) -> DataFrame:
    """Of the longest repeated substrings the first in order."""
    return longest_repeated(docs, sx).groupBy("doc_id").agg(F.min(F.struct("text", "positions")).alias("r")).select("doc_id", "r.text", "r.positions")


def count_unique_substrings(sx: DataFrame) -> DataFrame:
    """``(doc_id, count)`` of distinct substrings, from a suffix table whose ids do not
    repeat; :func:`unique_substrings` takes any texts."""
    return sx.groupBy("doc_id").agg(F.expr("count(1) * (count(1) + 1) div 2 - sum(lcp)").alias("count"))


def unique_substrings(docs: DataFrame, max_chars: int = suffix.MAX_CHARS) -> DataFrame:
    """The same from the texts, one row a text from the kernel on; null and empty
    texts have none.  Texts beyond ``max_chars`` go through their suffix tables."""
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    kept = _per_text(texts.filter(F.length("text") <= max_chars), "count long", [("count", pa.int64())], lambda t: [(kernels.unique_substrings(kernels.code_points(t)),)])
    giant = texts.filter(F.length("text") > max_chars)
    if not giant.take(1):
        return kept
    numbered = tables.write_table(giant.withColumn("at", F.monotonically_increasing_id()), "giant-texts")
    counts = count_unique_substrings(suffix.giant_tables(numbered.withColumn("doc_id", F.col("at")))).select(F.col("doc_id").alias("at"), "count")
    return kept.union(counts.join(numbered.select("at", "doc_id"), "at").select("doc_id", "count"))


def _unique(text: str) -> list[tuple[str, int]]:
    size, places = kernels.shortest_unique(kernels.code_points(text))
    return [(text[p : p + size], p) for p in places.tolist()]


_ONCE = ("text string, position int", [("text", pa.string()), ("position", pa.int32())])


@_from_texts(*_ONCE, _unique)
def shortest_unique(docs: DataFrame, sx: DataFrame) -> DataFrame:
    """``(doc_id, text, position)`` of all shortest substrings that occur once."""
    rows = _shortest(docs, sx)
    return _substring(rows.select("doc_id", "pos", "len"), docs).select("doc_id", "text", F.col("pos").alias("position"))


@_from_texts(*_ONCE, lambda text: _unique(text)[:1])
def first_shortest_unique(docs: DataFrame, sx: DataFrame) -> DataFrame:
    """The one of them that comes first in suffix order."""
    one = _shortest(docs, sx).groupBy("doc_id").agg(F.min(F.struct("rank", "pos", "len")).alias("f")).select("doc_id", "f.pos", "f.len")
    return _substring(one, docs).select("doc_id", "text", F.col("pos").alias("position"))


def _shortest(docs: DataFrame, sx: DataFrame) -> DataFrame:
    sizes = sx.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _next_lcp(sx).withColumn("len", F.greatest("lcp", "next") + 1).join(sizes, "doc_id").filter(F.col("pos") + F.col("len") <= F.col("n"))
    least = rows.groupBy("doc_id").agg(F.min("len").alias("len"))
    return rows.select("doc_id", "rank", "pos", "len").join(least, ["doc_id", "len"]).select("doc_id", "rank", "pos", "len")


def intervals(batches: Iterator[pa.RecordBatch], min_length: int, order_of: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``key`` and ``INTERVAL`` from a key and its texts; ``order_of`` gives sides,
    positions and common prefixes of their suffixes in order."""
    for b in batches:
        for i in range(b.num_rows):
            side, pos, lcp = order_of(*[c[i].as_py() for c in b.columns[1:]])
            found = kernels.lcp_intervals(lcp, pos, side, min_length)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(found), i))), *[pa.array(c, pa.int32()) for c in found.T]], names=["key", *INTERVAL])


#: Columns of an interval of suffixes.
INTERVAL = ["position1", "position2", "shortest", "longest", "count1", "count2"]


def repeat_intervals(docs: DataFrame, min_length: int = 2) -> DataFrame:
    """``(doc_id, position, shortest, longest, occurrences)``: all repeated substrings of
    at least ``min_length`` in a table no longer than the texts.

    A row is an interval of suffixes in order, a node of their tree: every prefix of
    the suffix at ``position`` (the first of them) from ``shortest`` to ``longest``
    characters occurs at the same ``occurrences`` places, and each repeated
    substring is named by exactly one row.  :func:`find_repeats` enumerates them."""
    if min_length < 1:
        raise ValueError("min_length must be positive")

    def order_of(text: str):
        order, lcp = kernels.suffix_order(kernels.code_points(text))
        return np.ones(len(order), np.int64), order, lcp

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0).mapInArrow(lambda batches: intervals(batches, min_length, order_of), f"key {kind}, " + ", ".join(f"{c} int" for c in INTERVAL))
    return rows.select(F.col("key").alias("doc_id"), F.col("position1").alias("position"), "shortest", "longest", F.col("count1").alias("occurrences"))


#: Rows that a worker hands over at a time, and those of one text more.
_ROWS = 1 << 15


def _per_text(docs: DataFrame, schema: str, kinds: list[tuple[str, pa.DataType]], f: Callable[[str], list[tuple]]) -> DataFrame:
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = f(text)
                rows += found
                at += [i] * len(found)
                if len(rows) >= _ROWS or rows and i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, k) for v, (_, k) in zip(zip(*rows), kinds)]], names=["doc_id", *[n for n, _ in kinds]])
                    rows, at = [], []

    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInArrow(run, f"doc_id {id_kind}, {schema}")


def tandem_repeats(docs: DataFrame, max_period: int | None = None) -> DataFrame:
    """``(doc_id, position, length, count)``: units repeated side by side; for each
    start the longest stretch.  The work is a text's length times its logarithm."""
    kinds = [(c, pa.int32()) for c in ("position", "length", "count")]
    return _per_text(docs, "position int, length int, count int", kinds, lambda t: kernels.tandem_repeats(kernels.code_points(t), max_period))


@by_row
def tandem_repeats_sql(docs: DataFrame, max_period: int) -> DataFrame:
    """The same for bounded periods with windows only: islands of agreement with
    the text moved by each period."""
    chars = docs.select("doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("c"))
    rows = chars.select("doc_id", "c", F.explode(F.sequence(F.lit(1), F.lit(max_period))).alias("d")).filter(F.size("c") >= 2 * F.col("d"))
    same = F.transform(F.slice("c", F.lit(1), F.size("c") - F.col("d")), lambda x, i: F.when(x == F.col("c")[i + F.col("d")], i))
    hits = rows.select("doc_id", "d", F.explode(F.filter(same, lambda i: i.isNotNull())).alias("i"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "d").orderBy("i"))
    runs = hits.withColumn("g", island).groupBy("doc_id", "d", "g").agg(F.min("i").alias("position"), F.count(F.lit(1)).alias("n")).filter("n >= d")
    runs = runs.select("doc_id", "position", F.col("d").alias("length"), F.expr("cast(n div d + 1 as int)").alias("count"))
    place = F.row_number().over(Window.partitionBy("doc_id", "position").orderBy(F.desc(F.col("length") * F.col("count")), "length"))
    return runs.withColumn("p", place).filter("p = 1").drop("p")


def lz78_complexity(docs: DataFrame) -> DataFrame:
    """``(doc_id, complexity)``: phrases of the LZ78 parsing."""
    return _per_text(docs, "complexity int", [("complexity", pa.int32())], lambda t: [(kernels.lz78(kernels.code_points(t)),)])


def longest_palindrome(docs: DataFrame) -> DataFrame:
    """``(doc_id, position, length)`` of the leftmost longest palindrome of two
    characters or more; texts without one have no row."""
    kinds = [("position", pa.int32()), ("length", pa.int32())]
    return _per_text(docs, "position int, length int", kinds, lambda t: [p] if (p := kernels.longest_palindrome(t)) else [])
