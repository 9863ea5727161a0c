"""Suffix tables of texts, common prefixes, and the Burrows-Wheeler transform.

``suffixes`` is ``(doc_id, rank, pos, lcp)``: suffixes by code point, each with
its common prefix with the one before (0 for the first).  One text is one unit
of work of a vectorised kernel; texts beyond ``max_chars`` go through
:func:`giant_tables`, which doubles prefixes with DataFrames.

Defined cases: null texts have no rows; empty ones have none either (a transform of
their own: "", -1); rows with null or repeated ids are texts of their own.  A suffix
table names its texts by id only, so operators that take one along with ``docs`` want
both keyed (:mod:`strandline.plans.keys`); without one they key the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.plans.keys import is_keyed, keyed, unkeyed
from strandline.plans.ranking import global_positions
from strandline.plans.suffix_order import suffix_order
from strandline.plans.tables import write_table

#: Longest text for the kernel, which needs some 100 bytes a character.
MAX_CHARS = 2_000_000


def suffixes(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Suffix table of every text; null and empty texts have no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                order, lcp = kernels.suffix_order(kernels.code_points(text))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.full(len(order), i))), pa.array(np.arange(len(order)), pa.int32()), pa.array(order, pa.int32()), pa.array(lcp, pa.int32())],
                    names=["doc_id", "rank", "pos", "lcp"],
                )

    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    kept = texts.filter(F.length("text") <= max_chars).mapInArrow(run, f"doc_id {kind}, rank int, pos int, lcp int")
    # texts are numbered before they are written, as ids may be null or repeated
    giant = texts.filter(F.length("text") > max_chars)
    return kept.union(giant_tables(_numbered(giant))) if giant.take(1) else kept


def giant_suffixes(chars: DataFrame) -> DataFrame:
    """``(pos, val)`` characters of one text of any length to ``(rank, pos)``.

    Ranks of prefixes of length 2k come from pairs of ranks of length k: an
    equi-join on positions and a global rank by range partitions.  Each round is
    written, so lineage stays short; log2(longest repeat) rounds.
    """
    coded = global_positions(chars.select("val").distinct(), ["val"], "r", 1)
    ranks = write_table(chars.join(F.broadcast(coded), "val").select("pos", "r"), "suffix-ranks")  # the alphabet bounds the broadcast
    total, k = ranks.count(), 1
    while True:
        ahead = ranks.select((F.col("pos") - k).alias("pos"), F.col("r").alias("r2"))
        pairs = write_table(ranks.join(ahead, "pos", "left").select("pos", "r", F.coalesce("r2", F.lit(0)).alias("r2")), "suffix-pairs")
        named = global_positions(pairs.select("r", "r2").distinct(), ["r", "r2"], "new", 1)
        ranks = write_table(pairs.join(named, ["r", "r2"]).select("pos", F.col("new").alias("r")), "suffix-ranks")
        if ranks.agg(F.max("r")).first()[0] in (None, total):
            return ranks.select((F.col("r") - 1).alias("rank"), "pos")
        k *= 2


def giant_tables(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, text, at)``, numbered by ``at``, to the rows of :func:`suffixes`."""
    order = suffix_order(texts.select("at", "text"), apart=True)
    ranks = write_table(order.ranks, "giant-ranks")
    before = ranks.select("at", (F.col("r") + 1).alias("r"), F.col("pos").alias("pos2"))
    pairs = ranks.join(before, ["at", "r"]).select(F.col("at").alias("at1"), F.col("pos").alias("pos1"), F.col("at").alias("at2"), "pos2", "r")
    lcp = order.common_prefixes(pairs).select(F.col("at1").alias("at"), F.col("pos1").alias("pos"), "r", "lcp")
    first = ranks.groupBy("at").agg(F.min("r").alias("first"))
    rows = lcp.unionByName(first.join(ranks, "at").filter("r = first").select("at", "pos", "r", F.lit(0).alias("lcp")))
    out = rows.join(first, "at").join(texts.select("at", "doc_id"), "at")
    return out.select("doc_id", *[F.expr(c).cast("int").alias(n) for c, n in (("r - first", "rank"), ("pos", "pos"), ("lcp", "lcp"))])


def with_table(docs: DataFrame, sx: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Keyed texts and their suffix table.  A given table must be keyed as the texts
    are, since ids that repeat would mix their suffixes."""
    if sx is None:
        docs = keyed(docs)
        return docs, write_table(suffixes(docs), "suffixes")
    if not (is_keyed(docs) and is_keyed(sx)):
        raise ValueError("a suffix table goes with keyed texts: docs = keyed(docs), sx = suffixes(docs)")
    return docs, sx


#: Pairs of a text that go through the kernel at a time.
_PAIRS = 1 << 16


def lcp_of_pairs(docs: DataFrame, sx: DataFrame | None, q: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``q(qid, doc_id, i, j)`` to the common prefix of the suffixes at i and j:
    the least ``lcp`` between their ranks; a suffix with itself has its length.  A
    query is answered for each text of its id (of a null id too).

    Without a suffix table a kernel compares the pairs of each text; texts beyond
    ``max_chars`` get a table."""
    if sx is not None:
        return _lcp_by_ranks(*with_table(docs, sx), q)
    docs = keyed(docs)
    some = docs.filter(F.length("text") <= max_chars)
    giant = docs.filter(F.length("text") > max_chars)
    kept = _lcp_by_text(some, q)
    return kept.union(_lcp_by_ranks(*with_table(giant, suffixes(giant)), q)) if giant.take(1) else kept


def _asked(docs: DataFrame, q: DataFrame) -> DataFrame:
    """``q`` for each text of its id: ``(qid, doc_id, i, j, n)``, keyed; ``n`` characters."""
    own = docs.select("doc_id", F.col("doc_id.id").alias("__id"), F.length("text").alias("n"))
    asked = q.withColumnRenamed("doc_id", "__asked")
    same_text = F.col("__asked") == F.col("doc_id") if is_keyed(q) else F.col("__asked").eqNullSafe(F.col("__id"))
    return asked.join(own, same_text).select("qid", "doc_id", "i", "j", "n")


def _lcp_by_text(docs: DataFrame, q: DataFrame) -> DataFrame:
    kind = q.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, pairs in zip(b.column(0), b.column(1)):
                qid, i, j = pairs.values.flatten()
                found = kernels.common_prefixes(kernels.code_points(text.as_py()), i.to_numpy(), j.to_numpy())
                yield pa.RecordBatch.from_arrays([qid, pa.array(found, pa.int32())], names=["qid", "lcp"])

    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("n"))
    asked = _asked(docs, q).filter(inside("i") & inside("j")).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.floor(F.monotonically_increasing_id() / _PAIRS))
    pairs = F.collect_list(F.struct("qid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))).alias("pairs")
    return asked.groupBy("doc_id", "__part", "__at").agg(pairs).join(docs, "doc_id").select("text", "pairs").mapInArrow(run, f"qid {kind}, lcp int")


def _lcp_by_ranks(docs: DataFrame, sx: DataFrame, q: DataFrame) -> DataFrame:
    r = sx.select("doc_id", "pos", "rank")
    q = _asked(docs, q).select(F.struct("qid", "doc_id").alias("qid"), "doc_id", "i", "j", "n")
    ranked = q.join(r.select("doc_id", F.col("pos").alias("i"), F.col("rank").alias("ri")), ["doc_id", "i"]).join(r.select("doc_id", F.col("pos").alias("j"), F.col("rank").alias("rj")), ["doc_id", "j"])
    span = ranked.withColumn("lo", F.least("ri", "rj")).withColumn("hi", F.greatest("ri", "rj"))
    from strandline.operators.ranges import range_min

    asked = span.filter("lo < hi").select("qid", F.col("doc_id").alias("seq_id"), (F.col("lo") + 1).cast("long").alias("start"), (F.col("hi") + 1).cast("long").alias("end"))
    between = range_min(sx.select(F.col("doc_id").alias("seq_id"), F.col("rank").cast("long").alias("pos"), F.col("lcp").alias("val")), asked, strict=False)
    same = span.filter("lo = hi").select("qid", (F.col("n") - F.col("i")).cast("int").alias("value"))
    return between.select("qid", "value").union(same).select("qid.qid", F.col("value").alias("lcp"))


def bwt(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(doc_id, bwt, original_index)``: for each suffix in order the character
    before it, the last one for the whole text; original_index is the whole
    text's rank (-1 for an empty text).  Texts beyond ``max_chars`` go through
    :func:`giant_tables`."""
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    kept = _transformed(texts.filter(F.length("text") <= max_chars))
    giant = texts.filter(F.length("text") > max_chars)
    return kept.union(_giant_bwt(_numbered(giant))) if giant.take(1) else kept


def _transformed(texts: DataFrame) -> DataFrame:
    """The transform text by text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], []
            for text in b.column(1).to_pylist():
                codes = kernels.code_points(text)
                order = kernels.Prefixes(codes).order
                out.append(codes[order - 1].tobytes().decode("utf-32-le", "surrogatepass"))
                at.append(int(np.flatnonzero(order == 0)[0]) if len(order) else -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(at, pa.int32())], names=["doc_id", "bwt", "original_index"])

    return texts.mapInArrow(run, f"doc_id {kind}, bwt string, original_index int")


def _numbered(df: DataFrame) -> DataFrame:
    """``at``, a row number, beside all columns; written."""
    return write_table(df.withColumn("at", F.monotonically_increasing_id()), "numbered")


#: Characters of a text that a task puts together.
_PIECE = 1 << 16


def _characters(texts: DataFrame, column: str) -> DataFrame:
    """``(at, pos, ch)`` of texts numbered by ``at``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = kernels.code_points(text)
                for lo in range(0, len(codes), _PIECE):
                    part = codes[lo : lo + _PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at)), pa.array(np.arange(lo, lo + len(part)), pa.int64()), pa.array(part, pa.int32())], names=["at", "pos", "ch"])

    return texts.select("at", column).mapInArrow(cut, "at long, pos long, ch int")


def _put_together(chars: DataFrame, order: str, name: str) -> DataFrame:
    """``(at, name)``: characters in order, pieces first, so that only a text's pieces meet."""
    pieces = chars.withColumn("__piece", F.floor(F.col(order) / _PIECE)).groupBy("at", "__piece").agg(F.array_sort(F.collect_list(F.struct(order, "ch"))).alias("a"))
    text = pieces.select("at", "__piece", F.array_join(F.transform("a", lambda x: _char(x["ch"])), "").alias("part"))
    whole = text.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("__piece", "part"))).alias("a"))
    return whole.select("at", F.array_join(F.transform("a", lambda x: x["part"]), "").alias(name))


def _char(code: Column) -> Column:
    """A code point's character (``chr`` knows one byte only)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _giant_bwt(texts: DataFrame) -> DataFrame:
    sx = giant_tables(texts.withColumn("doc_id", F.col("at"))).select(F.col("doc_id").alias("at"), "rank", "pos")
    sx = write_table(sx, "giant-order")
    sizes = texts.select("at", F.length("text").alias("n"))
    before = sx.join(sizes, "at").select("at", "rank", F.pmod(F.col("pos") - 1, F.col("n")).cast("long").alias("pos"))
    last = _put_together(before.join(_characters(texts, "text"), ["at", "pos"]).select("at", "rank", "ch"), "rank", "bwt")
    whole = sx.filter("pos = 0").select("at", F.col("rank").alias("original_index"))
    return last.join(whole, "at").join(texts.select("at", "doc_id"), "at").select("doc_id", "bwt", "original_index")


def restore(transformed: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(doc_id, text)`` from a transform whose text ends in its unique smallest
    character.  Transforms beyond ``max_chars`` are inverted by joins."""
    rows = transformed.select("doc_id", "bwt", "original_index").filter(F.col("bwt").isNotNull())
    kept = _restored(rows.filter(F.length("bwt") <= max_chars))
    giant = rows.filter(F.length("bwt") > max_chars)
    return kept.union(_giant_restore(_numbered(giant))) if giant.take(1) else kept


def _restored(rows: DataFrame) -> DataFrame:
    """The texts of transforms one by one."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [kernels.invert_bwt(kernels.code_points(t), i).tobytes().decode("utf-32-le", "surrogatepass") for t, i in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def _giant_restore(rows: DataFrame) -> DataFrame:
    """Every character's distance from the text's end, by doubling: the last-to-first map
    leads each place of the transform to that of the character before; a place knows
    its distance once its way has met the place of the text's last character."""
    chars = _characters(rows, "bwt")
    # places of a character follow its order: a global numbering, no window over a text
    sorted_ = global_positions(chars, ["at", "ch", "pos"], "g")
    first = sorted_.groupBy("at").agg(F.min("g").alias("base"), F.count(F.lit(1)).alias("n"))
    lf = write_table(sorted_.join(first, "at").select("at", "pos", "ch", "n", (F.col("g") - F.col("base")).alias("to")), "last-to-first")
    # walking back from the whole text's place, the k-th step reads the k-th character from the end;
    # reversed: each place points to the one that is read before it
    ahead = lf.select("at", F.col("to").alias("pos"), F.col("pos").alias("next"))
    ends = rows.select("at", F.col("original_index").cast("long").alias("end"))
    way = write_table(ahead.join(ends, "at").select("at", "pos", F.when(F.col("pos") != F.col("end"), F.col("next")).alias("next"), F.when(F.col("pos") != F.col("end"), F.lit(1)).otherwise(0).cast("long").alias("steps")), "ways")
    while not way.filter("next is not null").isEmpty():
        far = way.select("at", F.col("pos").alias("next"), F.col("next").alias("__next"), F.col("steps").alias("__steps"))
        open_, done = way.filter("next is not null"), way.filter("next is null")
        moved = open_.join(far, ["at", "next"]).select("at", "pos", F.col("__next").alias("next"), (F.col("steps") + F.col("__steps")).alias("steps"))
        way = write_table(moved.unionByName(done), "ways")
    read = way.join(lf.select("at", "pos", "ch", "n"), ["at", "pos"]).select("at", "ch", (F.col("n") - 1 - F.col("steps")).alias("place"))
    return _put_together(read, "place", "text").join(rows.select("at", "doc_id"), "at").select("doc_id", "text")


def terminated(docs: DataFrame, end: str = "\0") -> DataFrame:
    """Texts closed by a terminator, which makes their transform invertible."""
    return docs.select("doc_id", F.concat("text", F.lit(end)).alias("text"))


def full_text_restore(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Transforms terminated texts, inverts, and drops the terminator.  Texts are told apart
    by length before they are transformed, so that no transform is made to be measured."""
    closed = terminated(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    back = _restored(_transformed(closed.filter(F.length("text") <= max_chars)))
    giant = closed.filter(F.length("text") > max_chars)
    if giant.take(1):
        back = back.union(restore(bwt(giant, max_chars), max_chars))
    return back.select("doc_id", F.substring("text", F.lit(1), F.length("text") - 1).alias("text"))


def last_to_first(transformed: DataFrame) -> DataFrame:
    """``(doc_id, i, ch, lf)``: the last-to-first map of a transform."""
    own = keyed(transformed, columns=("bwt",))
    rows = own.select("doc_id", F.posexplode(F.filter(F.split("bwt", ""), lambda c: c != "")).alias("i", "ch"))
    return unkeyed(rows.withColumn("lf", F.row_number().over(Window.partitionBy("doc_id").orderBy("ch", "i")) - 1))


def unique_characters(docs: DataFrame) -> DataFrame:
    """``(doc_id, characters)``: each text's distinct characters, sorted."""
    return docs.select("doc_id", F.array_sort(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))).alias("characters"))
