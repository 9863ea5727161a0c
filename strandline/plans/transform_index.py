"""Backward search over a corpus: counts and places of patterns of any length, without
its texts.

Texts are dealt into groups of some ``GROUP`` characters, each with a transform of its own
that one task builds: an order of all the group's suffixes with the character before each, kept in
blocks.  Texts beyond ``suffix.MAX_CHARS`` share one that is built by joins.  A block has its characters and, for every character of the
alphabet, the place in the order of the next suffix that begins with it; so one
row tells where a step leads.  A pattern is read from its last character to its first and
narrows an interval of the order.  A group's blocks meet once, and all patterns are read there;
in larger transforms that takes one join a character for all patterns together; longer
patterns start earlier, so that all end with the same join.  Steps that several
patterns share are asked once.

Places are kept for every ``sample_rate``-th character of a text; from others the search
goes back character by character until it meets one, so a larger rate makes a smaller
index and longer walks, of ``sample_rate`` - 1 joins at most.

An index is built once, saved with a manifest, loaded with its checks, and grows by
batches, as the transforms are called, each with a number of its own.

Defined cases: null and empty texts hold nothing; null and empty patterns occur nowhere;
rows with null or repeated ids are texts of their own; an empty table is an index
without hits; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators.suffix import MAX_CHARS
from strandline.plans.ranking import global_positions
from strandline.plans.suffix_order import suffix_order, sums_before
from strandline.plans.tables import write_table
from strandline.sources import store

KIND = "transform"
#: Characters of a block at least; never fewer than the alphabet has, so that the starts
#: of all blocks are no more numbers than the texts have characters.
BLOCK = 2048
#: Characters of a group of texts, and those of one text more.
GROUP = 1 << 20
#: Characters of patterns that are sent to the workers at a time.
_SENT = 1 << 22
#: Hits of a pattern that one row of its interval unfolds to.
_HITS = 1 << 16
#: What is known of a pattern on its way.
_STATE = ("pid", "pattern", "batch", "width", "lo", "hi")


def _sign(code: int) -> str:
    """A character of its own for each number; 0 stands before a text's first one."""
    return chr(code if code < 0xD800 else code + 0x800)


def _code(sign: Column) -> Column:
    at = F.ascii(sign)
    return F.when(at >= 0xE000, at - 0x800).otherwise(at)


def _reached(code: Column, sign: Column) -> Column:
    """Where the step by a character leads from ``off`` characters into a block."""
    before = F.substring("signs", F.lit(1), F.col("off"))
    return F.element_at("starts", code + 1) + F.col("off") - F.length(F.replace(before, sign, F.lit("")))


@dataclass
class TransformIndex:
    """``blocks(batch, block, signs, starts, samples)``, ``symbols(batch, symbol, code, sign,
    size, width, sample_rate)``, the alphabet with the suffixes of its batch and how they
    are kept, and ``docs(batch, at, doc_id)``."""

    blocks: DataFrame
    symbols: DataFrame
    docs: DataFrame

    def append(self, docs: DataFrame, sample_rate: int = 16) -> TransformIndex:
        """The index with further texts, a batch of their own."""
        more = build(docs, sample_rate, batch=_new_batch())
        return TransformIndex(*[a.unionByName(b) for a, b in zip(self._parts().values(), more._parts().values())])

    def save(self, path: str) -> None:
        store.save(self._parts(), path, KIND)

    def _parts(self) -> dict[str, DataFrame]:
        return {"blocks": self.blocks, "symbols": self.symbols, "docs": self.docs}

    def _met(self, rows: DataFrame, at: str) -> DataFrame:
        """``rows`` with the block of a place, and ``off`` in it."""
        placed = rows.withColumn("block", F.floor(F.col(at) / F.col("width"))).withColumn("off", (F.col(at) % F.col("width")).cast("int"))
        return placed.join(self.blocks, ["batch", "block"])

    def intervals(self, patterns: DataFrame) -> DataFrame:
        """``(pattern, batch, width, lo, hi)``: where the suffixes that begin with a pattern
        stand in a batch; of each different ``pattern``, if it has any."""
        asked = patterns.select("pattern").filter(F.length("pattern") > 0).distinct().withColumn("pid", F.monotonically_increasing_id())
        asked = write_table(asked, "patterns")
        grouped = F.col("size") <= 2 * (GROUP + MAX_CHARS)
        small, large = self._of(grouped), self._of(~grouped)
        found = large._by_joins(asked) if large.symbols.take(1) else None
        total = asked.agg(F.sum(F.length("pattern"))).first()[0] or 0
        cuts = total // _SENT + 1
        for cut in range(cuts):
            part = small._by_group(asked.filter(F.pmod(F.xxhash64("pid"), F.lit(cuts)) == cut))
            found = part if found is None else found.unionByName(part)
        return found

    def _of(self, which: Column) -> TransformIndex:
        """The index of the batches that ``which``, over their symbols, holds for."""
        symbols = self.symbols.filter(which)
        return TransformIndex(self.blocks.join(symbols.select("batch").distinct(), "batch", "left_semi"), symbols, self.docs)

    def _by_group(self, asked: DataFrame) -> DataFrame:
        """All steps of all patterns where a batch's blocks meet."""
        rows = asked.collect()  # some _SENT characters
        sent = self.blocks.sparkSession.sparkContext.broadcast([(r["pid"], r["pattern"]) for r in rows])

        def narrowed(blocks: pa.Table, symbols: pa.Table) -> pa.Table:
            pids = np.array([p for p, _ in sent.value], np.int64)
            order = np.argsort(blocks["block"].to_numpy())
            last = np.concatenate([kernels.code_points(t) for t in blocks["signs"].take(pa.array(order)).to_pylist()] or [np.zeros(0, np.int32)])
            symbols = symbols.sort_by("code")
            alphabet = np.array([ord(c) for c in symbols["symbol"].to_pylist()], np.int64)
            found = kernels.backward_search(np.where(last >= 0xE000, last - 0x800, last), alphabet, [kernels.code_points(t) for _, t in sent.value])
            hit = np.flatnonzero(found[0] < found[1]) if len(alphabet) and len(last) else np.zeros(0, np.int64)
            same = lambda name: pa.array(np.full(len(hit), symbols[name][0].as_py() if len(hit) else 0), pa.int64())
            return pa.table({"pid": pa.array(pids[hit], pa.int64()), "batch": same("batch"), "width": same("width"), "lo": pa.array(found[0][hit], pa.int64()), "hi": pa.array(found[1][hit], pa.int64())})

        blocks = self.blocks.select("batch", "block", "signs").groupBy("batch")
        symbols = self.symbols.select("batch", "symbol", "code", "width").groupBy("batch")
        found = blocks.cogroup(symbols).applyInArrow(narrowed, "pid long, batch long, width long, lo long, hi long")
        return write_table(found.join(asked, "pid").select("pattern", "batch", "width", "lo", "hi"), "intervals")

    def _by_joins(self, asked: DataFrame) -> DataFrame:
        """One join a character."""
        longest = asked.agg(F.max(F.length("pattern"))).first()[0] or 0
        state = write_table(self._begun(asked.limit(0), 1).select(*_STATE), "intervals")
        for step in range(longest, 0, -1):
            last = F.substring("pattern", step, 1)
            known = state.withColumn("symbol", last).join(self.symbols.select("batch", "symbol", "code", "sign"), ["batch", "symbol"])
            begun = self._begun(asked.filter(F.length("pattern") == step), step)
            state = write_table(self._narrowed(known.unionByName(begun)), "intervals")
        return state.select("pattern", "batch", "width", "lo", "hi")

    def _begun(self, fresh: DataFrame, step: int) -> DataFrame:
        """Patterns at their last character, in each batch that has it: any suffix may follow."""
        first = fresh.withColumn("symbol", F.substring("pattern", step, 1)).join(self.symbols, "symbol")
        return first.select(*[F.lit(0).cast("long").alias(c) if c == "lo" else F.col("size").alias(c) if c == "hi" else F.col(c) for c in (*_STATE, "symbol", "code", "sign")])

    def _narrowed(self, known: DataFrame) -> DataFrame:
        asks = known.select("pid", "batch", "width", "pattern", "code", "sign", F.explode(F.array("lo", "hi")).alias("i"))
        once = self._met(asks.select("batch", "width", "code", "sign", "i").distinct(), "i")
        led = once.select("batch", "code", "i", _reached(F.col("code"), F.col("sign")).alias("to"))
        both = asks.join(led, ["batch", "code", "i"]).groupBy("pid", "batch").agg(F.any_value("width").alias("width"), F.any_value("pattern").alias("pattern"), F.min("to").alias("lo"), F.max("to").alias("hi"))
        return both.filter("lo < hi").select(*_STATE)

    def count(self, patterns: DataFrame) -> DataFrame:
        """``patterns(qid, pattern)`` to ``(qid, count)`` over all texts, 0 included; one
        row a row."""
        counts = self.intervals(patterns).groupBy("pattern").agg(F.sum(F.col("hi") - F.col("lo")).alias("__n"))
        return patterns.select("qid", "pattern").join(counts, "pattern", "left").select("qid", F.coalesce("__n", F.lit(0)).alias("count"))

    def locate(self, patterns: DataFrame) -> DataFrame:
        """``patterns(qid, pattern)`` to ``(qid, doc_id, position)``."""
        cuts = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(_HITS).cast("long")))
        parts = self.intervals(patterns).select("pattern", "batch", "width", "hi", cuts.alias("lo")).repartition("pattern", "batch", "lo")
        walks = parts.select("pattern", "batch", "width", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + _HITS) - 1)).alias("i"))
        rate = self.symbols.agg(F.max("sample_rate")).first()[0] or 1
        found = []
        for step in range(rate):
            met = self._met(walks, "i").withColumn("sample", F.get(F.filter("samples", lambda s: s["off"] == F.col("off")), F.lit(0))).withColumn("sign", F.substring("signs", F.col("off") + 1, F.lit(1)))
            back = F.when(F.col("sample").isNull(), _reached(_code(F.col("sign")), F.col("sign")))
            walked = write_table(met.select("pattern", "batch", "width", "sample", back.alias("i")), "walks")
            found.append(walked.filter("sample is not null").select("pattern", "batch", "sample.at", (F.col("sample.pos") + step).cast("int").alias("position")))
            walks = walked.filter("sample is null").drop("sample")
            if walks.isEmpty():
                break
        places = found[0]
        for f in found[1:]:
            places = places.union(f)
        asked = patterns.select("qid", "pattern")
        return asked.join(places.join(self.docs, ["batch", "at"]), "pattern").select("qid", "doc_id", "position")


def build(docs: DataFrame, sample_rate: int = 16, block: int = BLOCK, batch: int = 0, max_chars: int = MAX_CHARS) -> TransformIndex:
    """The index of ``docs(doc_id, text)``; its batches are numbered from ``batch`` on."""
    if sample_rate < 1 or block < 1:
        raise ValueError("sample_rate and block must be positive")
    # a number for the texts that share a transform, and one for every other text
    at = F.monotonically_increasing_id() + 1
    texts = write_table(docs.select("doc_id", "text").filter(F.length("text") > 0).withColumn("at", at), "transform-texts")
    index = _by_group(texts.filter(F.length("text") <= max_chars), sample_rate, block, batch)
    giant = texts.filter(F.length("text") > max_chars)
    if giant.take(1):
        more = _by_joins(giant, sample_rate, block, batch)
        index = TransformIndex(*[a.unionByName(b) for a, b in zip(index._parts().values(), more._parts().values())])
    return index


_SYMBOLS = "batch long, symbol string, code int, sign string, size long, width long, sample_rate int"


def _by_group(texts: DataFrame, sample_rate: int, block: int, batch: int) -> TransformIndex:
    """One transform for each ``GROUP`` characters of a partition's texts; its number is that
    of the first of them."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"batch long, block long, signs string, starts array<bigint>, samples array<struct<off:int,at:bigint,pos:bigint>>, symbols array<struct<{_SYMBOLS.replace(' ', ':')}>>, docs array<struct<at:bigint,doc_id:{kind}>>".replace(",:", ",")
    fields = [(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in _SYMBOLS.split(", ")]

    def transformed(ats: list[int], ids: list[pa.Array], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = batch + ats[0]
        last, order, alphabet = kernels.joint_transform(codes)
        size, width = len(last), max(block, 1 << len(alphabet).bit_length())
        blocks = size // width + 1
        counts = np.bincount(np.arange(size) // width * (len(alphabet) + 1) + last, minlength=blocks * (len(alphabet) + 1)).reshape(blocks, -1)
        smaller = np.concatenate([[0], np.cumsum(counts.sum(axis=0))[:-1]])
        starts = smaller + np.cumsum(counts, axis=0) - counts
        signs = np.where(last < 0xD800, last, last + 0x800).astype("<u4").tobytes().decode("utf-32-le")
        begins = np.cumsum([0, *[len(c) + 1 for c in codes]])
        text = np.searchsorted(begins, order, side="right") - 1
        pos = order - begins[text]
        kept = np.flatnonzero(pos % sample_rate == 0)
        sample = pa.StructArray.from_arrays([pa.array(kept % width, pa.int32()), pa.array(np.array(ats)[text[kept]], pa.int64()), pa.array(pos[kept], pa.int64())], names=["off", "at", "pos"])
        ends = np.searchsorted(kept, np.arange(blocks + 1) * width)
        symbols = pa.array([dict(zip([n for n, _ in fields], (own, chr(c), i, _sign(i), size, width, sample_rate))) for i, c in enumerate(alphabet.tolist(), 1)], pa.struct(fields))
        docs = pa.StructArray.from_arrays([pa.array(ats, pa.int64()), pa.concat_arrays(ids)], names=["at", "doc_id"])
        once = lambda a: pa.ListArray.from_arrays(pa.array([0, *[len(a)] * blocks], pa.int32()), a)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(blocks, own), pa.int64()),
                pa.array(np.arange(blocks), pa.int64()),
                pa.array([signs[i * width : (i + 1) * width] for i in range(blocks)], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(blocks + 1) * (len(alphabet) + 1), pa.int32()), pa.array(starts.ravel(), pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sample),
                once(symbols),
                once(docs),
            ],
            names=["batch", "block", "signs", "starts", "samples", "symbols", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ats, ids, codes, held = [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                ats.append(b.column(0)[i].as_py())
                ids.append(b.column(1).slice(i, 1))
                codes.append(kernels.code_points(b.column(2)[i].as_py()))
                held += len(codes[-1])
                if held >= GROUP:
                    yield from transformed(ats, ids, codes)
                    ats, ids, codes, held = [], [], [], 0
        if ats:
            yield from transformed(ats, ids, codes)

    made = write_table(texts.select("at", "doc_id", "text").mapInArrow(run, schema), "transform-groups")
    first = made.filter("block = 0")
    symbols = first.select(F.inline("symbols"))
    docs = first.select("batch", F.explode("docs").alias("d")).select("batch", "d.at", "d.doc_id")
    return TransformIndex(made.select("batch", "block", "signs", "starts", "samples"), symbols, docs)


def _by_joins(texts: DataFrame, sample_rate: int, block: int, batch: int) -> TransformIndex:
    """One transform of all ``texts(at, doc_id, text)``."""
    spark = texts.sparkSession
    order = suffix_order(texts.select("at", "text"), apart=False)
    width = max(block, 1 << len(order.alphabet).bit_length())
    # behind each text stands a suffix without characters, before all others
    first = F.call_function("shiftright", F.col("code"), F.lit((order.width - 1) * order.bits))
    before = order.codes.select("at", (F.col("pos") + 1).alias("pos"), first.cast("int").alias("code"), "left")
    ends = before.filter(F.col("left") == 1).select("at", "pos", F.lit(-1).cast("long").alias("r"))
    # equal suffixes stand in the order of their texts, and so do the longer ones they end
    placed = global_positions(order.ranks.unionByName(ends), ["r", "at"], "i").join(before.drop("left"), ["at", "pos"], "left")
    sample = F.when(F.col("pos") % sample_rate == 0, F.struct("at", "pos"))
    cells = write_table(placed.select(F.floor(F.col("i") / width).alias("block"), (F.col("i") % width).cast("int").alias("off"), F.coalesce("code", F.lit(0)).alias("code"), sample.alias("sample")), "cells")
    size = cells.count()
    signs = [(batch, chr(c), i, _sign(i), size, width, sample_rate) for i, c in enumerate(order.alphabet, 1)]
    symbols = spark.createDataFrame(signs, _SYMBOLS)
    drawn = spark.createDataFrame([(i, _sign(i)) for i in range(len(signs) + 1)], "code int, sign string")
    kept = cells.join(drawn, "code").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("off", "sign", "sample"))).alias("cells"))
    sampled = F.filter("cells", lambda c: c["sample"].isNotNull())
    kept = kept.select("block", F.array_join("cells.sign", "").alias("signs"), F.transform(sampled, lambda c: F.struct(c["off"].alias("off"), c["sample"]["at"].alias("at"), c["sample"]["pos"].alias("pos"))).alias("samples"))
    # every character in every block, and one block behind the last place
    grid = spark.range(size // width + 1).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(len(order.alphabet)))).alias("code"), F.lit(0).cast("long").alias("n"))
    counted = cells.groupBy("block", "code").agg(F.count(F.lit(1)).alias("n")).unionByName(grid).groupBy("code", "block").agg(F.sum("n").alias("n"))
    # what stands before in this order: all smaller characters, and this one in earlier blocks
    starts = sums_before(counted, ["code", "block"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "s"))).alias("all")).select("block", F.col("all.s").alias("starts"))
    whole = starts.join(kept, "block", "left")
    blocks = whole.select(F.lit(batch).cast("long").alias("batch"), "block", F.coalesce("signs", F.lit("")).alias("signs"), "starts", "samples")
    named = texts.select(F.lit(batch).cast("long").alias("batch"), "at", "doc_id")
    return TransformIndex(write_table(blocks.repartitionByRange("block").sortWithinPartitions("block"), "transform-blocks"), symbols, named)


def _new_batch() -> int:
    """A random number, so that two appends at once do not share it."""
    return uuid.uuid4().int >> 66  # texts are counted from it


def load(spark: SparkSession, path: str) -> TransformIndex:
    parts = store.load(spark, path, KIND)
    return TransformIndex(*[parts[p] for p in ("blocks", "symbols", "docs")])


def append_to(spark: SparkSession, path: str, docs: DataFrame, sample_rate: int = 16) -> None:
    """Adds texts to a saved index: further files and their manifest, nothing is rewritten."""
    store.append(build(docs, sample_rate, batch=_new_batch())._parts(), path, KIND)
