"""A kept gram index: count and locate many patterns without scanning texts.

Of every ``window`` neighbouring grams (``gram`` characters each) of a text the one
with the least hash is indexed, with its positions, one row a text and gram.  A
pattern that spans a window has such a gram wherever it stands, so it is looked
up by the rarest of its own; its candidates are compared with the text.  Shorter
patterns are answered by one pass over the texts, :func:`occurrences`.

An index is built once, saved with a manifest, loaded with its checks, and grows
by batches.  Rows are numbered, so that null and repeated ids stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from strandline.functions import kernels
from strandline.plans.tables import write_table
from strandline.sources import store

#: Characters of a gram (a power of two), and grams of which one is indexed.
GRAM = 8
WINDOW = 8
#: Lengths of the windows that :func:`occurrences` hashes, and bits of its map.
ANCHORS = (1, 2, 4, 8, 16, 32)
MAP_BITS = 1 << 24
KIND = "grams"
#: Grams that a worker holds before it hands them over, and those of one text more.
HELD = 1 << 16


@dataclass
class GramIndex:
    """``docs(batch, row, doc_id, text)`` and ``postings(gram, batch, row, positions)``."""

    docs: DataFrame
    postings: DataFrame
    gram: int = GRAM
    window: int = WINDOW

    @property
    def shortest(self) -> int:
        """Characters of the shortest pattern that the index answers by itself."""
        return self.gram + self.window - 1

    def append(self, docs: DataFrame) -> GramIndex:
        """The index with further texts, a batch of their own."""
        more = build(docs, self.gram, self.window, _new_batch())
        return GramIndex(self.docs.unionByName(more.docs), self.postings.unionByName(more.postings), self.gram, self.window)

    def save(self, path: str) -> None:
        store.save(self._parts(), path, KIND)

    def _parts(self) -> dict[str, DataFrame]:
        settings = self.docs.sparkSession.createDataFrame([(self.gram, self.window)], "gram int, window int")
        return {"docs": self.docs, "postings": self.postings, "settings": settings}

    def locate(self, patterns: DataFrame) -> DataFrame:
        """``patterns(qid, pattern)`` of any length to ``(qid, doc_id, position)``; an
        empty or null pattern occurs nowhere."""
        asked = patterns.select("qid", "pattern")
        long = F.length("pattern") >= self.shortest
        own = write_table(_least_grams(asked.filter(long), ["qid", "pattern"], "pattern", self.gram, self.window).select("qid", "pattern", "gram", F.explode("positions").alias("at")), "pattern-grams")
        # only the patterns' grams go on: the postings are read once and not shuffled if these are few
        hits = write_table(self.postings.join(own.select("gram").distinct(), "gram", "left_semi"), "gram-hits")
        counts = hits.groupBy("gram").agg(F.sum(F.size("positions")).alias("df"))
        rated = own.join(counts, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        probe = rated.groupBy("qid", "pattern").agg(F.min(F.struct("df", "at", "gram")).alias("p")).select("qid", "pattern", "p.at", "p.gram")
        found = probe.join(hits, "gram").select("qid", "pattern", "batch", "row", F.explode("positions").alias("pos"), "at")
        short = occurrences(self.docs.select("doc_id", "text"), asked.filter(~long))
        return _verified(self.docs, found, ["batch", "row"]).unionByName(short)

    def count(self, patterns: DataFrame) -> DataFrame:
        """``(qid, count)`` of every pattern over all texts, 0 included."""
        counts = self.locate(patterns).groupBy("qid").agg(F.count(F.lit(1)).alias("__n"))
        return patterns.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("__n", F.lit(0)).alias("count"))


def build(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, batch: int = 0) -> GramIndex:
    """The index of ``docs(doc_id, text)``; null texts have no postings."""
    if gram < 1 or gram & (gram - 1) or window < 1:
        raise ValueError("gram must be a power of two, and window positive")
    rows = write_table(docs.select(F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "gram-docs")
    postings = _least_grams(rows.filter(F.length("text") >= gram + window - 1), ["batch", "row"], "text", gram, window)
    # in order of the gram, so that readers of a few grams skip the rest by statistics;
    # what a gram of most texts has is split
    dealt = postings.hint("rebalance", "gram").sortWithinPartitions("gram")
    return GramIndex(rows, write_table(dealt, "gram-postings"), gram, window)


def _new_batch() -> int:
    """A random number, so that two appends at once do not share it."""
    return uuid.uuid4().int >> 65


def load(spark: SparkSession, path: str) -> GramIndex:
    parts = store.load(spark, path, KIND)
    gram, window = parts["settings"].first()
    return GramIndex(parts["docs"], parts["postings"], gram, window)


def append_to(spark: SparkSession, path: str, docs: DataFrame) -> None:
    """Adds texts to a saved index: further files and their manifest, nothing is rewritten."""
    kept = load(spark, path)
    more = build(docs, kept.gram, kept.window, _new_batch())
    store.append({"docs": more.docs, "postings": more.postings}, path, KIND)


def _least_grams(rows: DataFrame, keys: list[str], text: str, gram: int, window: int) -> DataFrame:
    """``keys``, ``gram`` and ``positions`` of the grams to index."""
    kept = rows.select(*keys, F.col(text).alias("__text"))
    schema = kept.select(*keys).schema.add("gram", LongType()).add("positions", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, grams, sizes, places, held = [], [], [], [], 0
            for i in range(b.num_rows):
                h, pos = kernels.least_grams(kernels.code_points(b.column(len(keys))[i].as_py()), gram, window)
                order = np.argsort(h, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else order
                at.append(np.full(len(head), i))
                grams.append(h[order][head])
                sizes.append(np.diff(np.append(head, len(h))))
                places.append(pos[order])
                held += len(h)
                if held >= HELD or i == b.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()), pa.array(np.concatenate(places), pa.int32()))
                    take = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[: len(keys)]], pa.array(np.concatenate(grams), pa.int64()), lists], names=schema.names)
                    at, grams, sizes, places, held = [], [], [], [], 0

    return kept.mapInArrow(run, schema)


def bit_map(rows: DataFrame, size: int) -> Broadcast:
    """Which of ``size`` bits, a power of two, the lowest ones of ``gram`` name; sent to workers."""
    bit = F.col("gram").bitwiseAND(F.lit(size - 1))
    marked = rows.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(size // 8, np.uint8)
    for bucket, bits in marked.collect():  # size / 8 bytes at most
        at = (bucket - 1) * 4096  # buckets and bits count from one
        whole[at : at + len(bits)] = np.frombuffer(bytes(bits), np.uint8)[: size // 8 - at]
    return rows.sparkSession.sparkContext.broadcast(whole.tobytes())


def in_map(h: np.ndarray, sent: Broadcast) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    bits = np.frombuffer(sent.value, np.uint8)
    low = h & (8 * len(bits) - 1)
    return np.flatnonzero((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns(qid, pattern)`` of every length, long passages too, to ``(qid,
    doc_id, position)``; an empty pattern occurs nowhere.

    No index is written: a pattern's anchor is its first 1, 2, 4, ... or 32
    characters, as many as it has.  One pass over the texts hashes the windows of
    these lengths; a bit map of fixed size lets most of them go in the worker, and
    those left are joined on the hash and compared with the whole pattern."""
    qid = patterns.schema["qid"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    probe, sizes = _anchors(patterns)
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"qid {qid}, doc_id {kind}, position int")
    sent = bit_map(probe, MAP_BITS)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for h in kernels.window_hashes(kernels.code_points(b.column(1)[i].as_py()), sizes).values():
                    pos = in_map(h, sent)
                    if len(pos):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(pos), i))), pa.array(pos, pa.int32()), pa.array(h[pos], pa.int64())], names=["row", "pos", "gram"])

    rows = write_table(docs.filter(F.length("text") > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    found = rows.select("row", "text").mapInArrow(hits, "row long, pos int, gram long")
    return _verified(rows, probe.drop("size").join(found, "gram"), ["row"])


def having(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows(row, text)`` and ``patterns(qid, pattern)`` to ``(row, qid)``: the texts that have
    the first 1, 2, 4, ... or 32 characters of a pattern, by their hash, and so may have it.
    One row a text and pattern, however many hits there are."""
    qid = patterns.schema["qid"].dataType.simpleString()
    probe, sizes = _anchors(patterns)
    if not sizes:
        return rows.sparkSession.createDataFrame([], f"row long, qid {qid}")
    sent = bit_map(probe, MAP_BITS)

    def had(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, grams = [], []
            for i in range(b.num_rows):
                found = [np.unique(h[in_map(h, sent)]) for h in kernels.window_hashes(kernels.code_points(b.column(1)[i].as_py()), sizes).values()]
                owner.append(np.full(sum(map(len, found)), i))
                grams += found
            if grams:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(grams), pa.int64())], names=["row", "gram"])

    found = rows.filter(F.length("text") > 0).select("row", "text").mapInArrow(had, "row long, gram long")
    return probe.select("qid", "gram").join(found, "gram").select("row", "qid")


def _anchors(patterns: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(qid, pattern, at, size, gram)``, the hash of each pattern's beginning, and the sizes of these."""
    qid = patterns.schema["qid"].dataType.simpleString()

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [kernels.code_points(t) for t in b.column(1).to_pylist()]
            sizes = [max(g for g in ANCHORS if g <= len(c)) for c in codes]
            hashes = [int(kernels.window_hashes(c[:g], [g])[g][0]) for c, g in zip(codes, sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([0] * len(codes), pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["qid", "pattern", "at", "size", "gram"])

    asked = patterns.select("qid", "pattern").filter(F.length("pattern") > 0)
    probe = write_table(asked.mapInArrow(anchor, f"qid {qid}, pattern string, at int, size int, gram long"), "anchors")
    return probe, sorted(r[0] for r in probe.select("size").distinct().collect())


def _verified(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    found = found.withColumn("position", F.col("pos") - F.col("at")).filter("position >= 0").select(*keys, "qid", "pattern", "position")
    return found.join(docs.select(*keys, "doc_id", "text"), keys).filter(F.expr("substring(text, position + 1, length(pattern)) = pattern")).select("qid", "doc_id", "position")
