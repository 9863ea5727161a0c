"""What texts of a corpus share with the others: no pair of texts is ever formed.

:func:`shared_stretches` puts the suffixes of many texts into one order, where the
text that shares most with a suffix is the nearest one of another text on either
side.  Before anything is sorted, grams tell which positions can matter: in a
match of ``min_length`` every window of grams has its least one at the same place, in an
asked text and in another one.  What windows with such a gram can reach, with the gram behind
it, is cut out as runs; two suffixes that share more differ before they leave their runs, so
what they have in common is exact.  Runs of the same characters are one; those of several
texts share all of themselves, and only the different ones are sorted.

Defined cases: null and empty texts share nothing; rows with null or repeated ids are
texts of their own, so a copy of an asked row shares all of it; a text is never
compared with itself; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.plans import asof
from strandline.plans.gram_index import bit_map, in_map
from strandline.plans.ranking import global_positions
from strandline.plans.suffix_order import suffix_order
from strandline.plans.tables import write_table

#: Positions of one bitmap, as Spark cuts them.
_BITS = 32_768


#: Bits of the map of asked grams at most, and bits a gram.
_MAP_BITS = 1 << 27
_BITS_A_GRAM = 16
#: Characters of different runs that are put in order; of more, lengths are tried.
_FEW = 1 << 12


def _gram_rows(texts: DataFrame, gram: int, window: int, sent: Broadcast | None = None) -> DataFrame:
    """``(at, asked, pos, gram)`` of the positions whose gram is the least of a window; of
    those in the map, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, asked, text in zip(*[c.to_pylist() for c in b.columns]):
                h, pos = kernels.least_grams(kernels.code_points(text), gram, window)
                if sent is not None:
                    kept = in_map(h, sent)
                    h, pos = h[kept], pos[kept]
                for lo in range(0, len(h), 1 << 16):
                    part = h[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), at)), pa.array(np.full(len(part), asked)), pa.array(pos[lo : lo + (1 << 16)], pa.int64()), pa.array(part)], names=["at", "asked", "pos", "gram"]
                    )

    return texts.select("at", "asked", "text").mapInArrow(run, "at long, asked boolean, pos long, gram long")


def _runs(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """``(run, doc, asked, start, text)``: the stretches within reach of shared grams, each
    with the gram behind it.  Positions come back to their text as bits."""
    asked = write_table(_gram_rows(texts.filter("asked"), gram, window).select("gram"), "asked-grams")
    size = min(_MAP_BITS, max(1 << 18, 1 << (_BITS_A_GRAM * asked.count()).bit_length()))
    rows = write_table(_gram_rows(texts, gram, window, bit_map(asked, size)), "grams")
    shared = rows.groupBy("gram").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("asked").alias("asked")).filter("lo < hi and asked")
    places = rows.select("at", "pos", "gram").join(shared.select("gram"), "gram", "left_semi")
    bits = places.groupBy("at", F.bitmap_bucket_number(F.col("pos") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("pos") + 1)).alias("bits"))
    marked = bits.groupBy("at").agg(F.collect_list(F.struct("bucket", "bits")).alias("maps"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, asked, text, maps in zip(*[c.to_pylist() for c in b.columns]):
                mask = np.zeros(max(max(m["bucket"] for m in maps) * _BITS, len(text)) + 2, bool)
                for m in maps:
                    own = np.unpackbits(np.frombuffer(m["bits"], np.uint8), bitorder="little")
                    lo = (m["bucket"] - 1) * _BITS + 1  # one place before the text
                    mask[lo : lo + len(own)] = own
                # a window reaches as many grams to both sides of its least one
                near = np.zeros(len(mask) + 1, np.int64)
                places = np.flatnonzero(mask)
                np.add.at(near, np.maximum(places - window + 1, 1), 1)
                np.add.at(near, np.minimum(places + window, len(text) - gram + 2), -1)
                mask = np.append(np.cumsum(near)[:-1] > 0, False)
                edges = np.flatnonzero(np.diff(mask.astype(np.int8)))
                starts, ends = edges[::2], edges[1::2]
                cuts = [text[s : e + gram] for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(cuts), pa.int64()), pa.array([asked] * len(cuts), pa.bool_()), pa.array(starts, pa.int64()), pa.array(cuts, pa.string())], names=["doc", "asked", "start", "text"])

    found = texts.join(marked, "at").select("at", "asked", "text", "maps").mapInArrow(cut, "doc long, asked boolean, start long, text string")
    return write_table(found.withColumn("run", F.monotonically_increasing_id()), "runs")


def _units(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with the number ``at`` of their characters, and ``(at, text, lo, hi, asked)`` of
    these: the first and last place in order; ``asked`` if one text alone has them and is asked."""
    place = F.struct("doc", "start")
    hashed = runs.withColumn("digest", F.sha2("text", 256))
    found = hashed.groupBy("digest").agg(F.min("run").alias("at"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("asked").alias("asked"))
    found = write_table(found, "units")
    named = write_table(hashed.join(found.select("digest", "at"), "digest").select("run", "at", "doc", "asked", "start", "text"), "named-runs")
    own = named.filter("run = at").select("at", "text")
    units = own.join(found.select("at", "lo", "hi", ((F.col("lo.doc") == F.col("hi.doc")) & F.col("asked")).alias("asked")), "at")
    return named.select("at", "doc", "asked", "start"), write_table(units, "run-units")


def _neighbours(rows: DataFrame) -> DataFrame:
    """``rows(idx, doc, asked, at, pos)`` in order to pairs of each asked suffix and the
    nearest ones before and after it that belong to another text."""
    total = rows.count()
    block = max(asof.BLOCK, total >> 15)  # no more than 2^15 blocks
    beside = lambda step: rows.select((F.col("idx") + step).alias("idx"), F.col("doc").alias(f"doc{step}"))
    known = rows.join(beside(1), "idx", "left").join(beside(-1), "idx", "left")
    first = F.when(F.col("doc1").isNull() | (F.col("doc1") != F.col("doc")), F.col("idx"))
    last = F.when(F.col("doc-1").isNull() | (F.col("doc-1") != F.col("doc")), F.col("idx"))
    known = known.select(*rows.columns, first.alias("first"), last.alias("last"))
    ahead = asof.running(known, [], "idx", "at", F.col("first"), "since", block=block)
    both = asof.running(ahead, [], "idx", "at", F.col("last"), "until", largest=False, backward=True, block=block)
    asked = both.filter("asked").select("at", "pos", F.explode(F.array(F.col("since") - 1, F.col("until") + 1)).alias("idx"))
    other = rows.select("idx", F.col("at").alias("at2"), F.col("pos").alias("pos2"))
    return asked.join(other, "idx").select(F.col("at").alias("at1"), F.col("pos").alias("pos1"), "at2", "pos2")


#: Characters of texts that are named in one call.
_CALL = 1 << 18


def _together(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Neighbouring texts of some :data:`_CALL` characters: the first, the one behind the
    last, their characters behind one another, and where each begins and ends there."""
    lo = 0
    while lo < len(texts):
        hi, ends = lo, [0]
        while hi < len(texts) and (hi == lo or ends[-1] + len(texts[hi]) <= _CALL):
            ends.append(ends[-1] + len(texts[hi]))
            hi += 1
        yield lo, hi, kernels.code_points("".join(texts[lo:hi])), np.array(ends)
        lo = hi


def _starts(units: DataFrame, size: int, sent: Broadcast | None = None) -> DataFrame:
    """``(at, pos, doc, asked, before, a, gram)``: the names of all windows of ``size`` characters and
    the character before them (a number of its own where a run begins); of those in the map, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, docs, asked = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)]
            for first, last, codes, ends in _together(batch.column(1).to_pylist()):
                text = np.repeat(np.arange(last - first), np.diff(ends))
                place = np.flatnonzero(np.arange(len(codes)) + size <= ends[text + 1])
                x, y = kernels.Stretches(codes).names(place, place + size)
                if sent is not None:
                    kept = in_map(y, sent)
                    place, x, y = place[kept], x[kept], y[kept]
                text = text[place]
                pos, row = place - ends[text], text + first
                before = np.where(pos > 0, codes[place - 1], -1 - ats[row])
                columns = [ats[row], pos, docs[row], asked[row], before, x, y]
                for lo in range(0, len(pos), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], names=["at", "pos", "doc", "asked", "before", "a", "gram"])

    return units.select("at", "text", "doc", "asked").mapInArrow(run, "at long, pos long, doc long, asked boolean, before long, a long, gram long")


#: Lengths of a bracket that are tried at once.
_STEPS = 32


def _tried(texts: DataFrame, places: DataFrame, doubling: bool) -> DataFrame:
    """``places(at, pos, doc, before, query, lo, hi)`` with the lengths ``size`` in [lo, hi) that are tried
    (``doubling``: lo, twice lo and so on), the length ``next`` tried after it, and the names of both:
    ``a, b`` and ``c, d`` (of what is left, if that is shorter)."""
    asked = places.groupBy("at").agg(F.collect_list(F.struct("pos", "doc", "before", "lo", "hi", "query")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(_STEPS + 1)
        for batch in batches:
            ats, lists = batch.column(0).to_numpy(), batch.column(2)
            offsets = lists.offsets.to_numpy()
            for first, last, codes, ends in _together(batch.column(1).to_pylist()):
                named = kernels.Stretches(codes)
                own = lists.values.slice(offsets[first], offsets[last] - offsets[first])
                held = [own.field(k).to_numpy(zero_copy_only=False) for k in range(6)]
                held.append(np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])))
                for cut in range(0, len(own), 1 << 12):
                    pos, doc, before, lo, hi, query, text = [x[cut : cut + (1 << 12)] for x in held]
                    parts = np.minimum(_STEPS, hi - lo)[:, None]
                    grid = lo[:, None] << steps if doubling else lo[:, None] + (hi - lo)[:, None] * steps // parts
                    left = (ends[text + 1] - ends[text] - pos)[:, None]
                    row, k = np.nonzero((grid[:, :-1] <= left) & (doubling | (steps[:-1] < parts)))
                    size, more, start = grid[row, k], grid[row, k + 1], (ends[text] + pos)[row]
                    a, b = named.names(start, start + size)
                    c, d = named.names(start, np.minimum(start + more, ends[text[row] + 1]))
                    columns = [ats[first + text[row]], pos[row], doc[row], before[row], size, more, a, b, c, d, query[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["at", "pos", "doc", "before", "size", "next", "a", "b", "c", "d", "query"])

    met = texts.join(asked, "at").select("at", "text", "places")
    return met.mapInArrow(run, "at long, pos long, doc long, before long, size long, next long, a long, b long, c long, d long, query boolean")


def _longest(units: DataFrame, min_length: int) -> DataFrame:
    """``(at1, pos1, lcp, at2, pos2)``: for ``units(at, text, doc, asked)`` the asked places
    from which most characters, ``min_length`` or more, are shared with another text, and
    where no such text has the same character before them too.

    Only windows that occur behind different characters can be such places.  Lengths are tried
    by doubling, then in ever finer brackets.  In a bracket's class, whose stretches agree
    up to its lower end, those that also agree up to its upper end are two rows, of different
    texts if there are any: so a class is as many rows as it has different stretches."""
    windows = _starts(units, min_length)
    kept = windows.groupBy("a", "gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("asked").alias("asked"), F.min("before").alias("low"), F.max("before").alias("high"))
    kept = write_table(kept.filter("lo < hi and asked and low < high").select("a", "gram"), "classes")
    size = min(_MAP_BITS, max(1 << 18, 1 << (_BITS_A_GRAM * kept.count()).bit_length()))
    met = _starts(units, min_length, bit_map(kept, size)).join(kept, ["a", "gram"], "left_semi")
    places = met.select("at", "pos", "doc", "before", F.col("asked").alias("query"), F.lit(min_length).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    texts, done, doubling = units.select("at", "text"), None, True
    name, place = ["size", "a", "b"], F.struct("doc", "at", "pos")
    ends = lambda df, *by: df.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    while True:
        tried = write_table(_tried(texts, places, doubling), "lengths")
        spots = tried.withColumn("lo", place).withColumn("hi", place)
        beside = write_table(ends(spots, *name, "before"), "beside")
        groups = ends(beside, *name).filter("lo.doc < hi.doc")
        other = F.when(F.col("lo.doc") == F.col("doc"), F.col("hi")).otherwise(F.col("lo"))
        most = F.max(F.struct("size", "next", "a", "b", "doc", "before", other.alias("other"))).alias("m")
        found = write_table(tried.filter("query").join(groups, name).groupBy("at", "pos").agg(most).select("at", "pos", "m.*"), "found")
        exact = found.filter(F.col("next") == F.col("size") + 1).join(beside.filter("lo.doc < hi.doc"), [*name, "before"], "left_anti")
        exact = write_table(exact.select(F.col("at").alias("at1"), F.col("pos").alias("pos1"), F.col("size").cast("int").alias("lcp"), F.col("other.at").alias("at2"), F.col("other.pos").alias("pos2")), "longest")
        done = exact if done is None else done.union(exact)
        going = found.filter(F.col("next") > F.col("size") + 1)
        if going.isEmpty():
            return done
        members = ends(spots.join(going.select(*name).distinct(), name, "left_semi"), *name, "next", "c", "d", "before")
        members = members.select("size", "next", "before", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p"))
        members = members.select("p.at", "p.pos", "p.doc", "before", F.lit(False).alias("query"), F.col("size").alias("lo"), F.col("next").alias("hi"))
        places = write_table(members.unionByName(going.select("at", "pos", "doc", "before", F.lit(True).alias("query"), F.col("size").alias("lo"), F.col("next").alias("hi"))), "places")
        doubling = False


def _in_order(units: DataFrame, min_length: int) -> DataFrame:
    """The same for few characters, by the order of their suffixes; also places that a longer
    stretch from one character earlier contains."""
    order = suffix_order(units.select("at", "text"), apart=False)
    places = units.select("at", "doc", "asked")
    rows = write_table(global_positions(order.ranks, ["r", "at", "pos"], "idx").join(places, "at").select("idx", "doc", "asked", "at", "pos"), "suffixes")
    found = order.common_prefixes(write_table(_neighbours(rows), "neighbours")).filter(F.col("lcp") >= min_length)
    return found.groupBy("at1", "pos1").agg(F.max(F.struct("lcp", "at2", "pos2")).alias("b")).select("at1", "pos1", "b.*")


def shared_stretches(docs: DataFrame, asked: Column, min_length: int) -> DataFrame:
    """``(doc_id, position, length, other_id, other_position)``: every stretch of at least
    ``min_length`` characters that a text for which ``asked`` holds has in common with
    another text of ``docs(doc_id, text)``, and that no longer such stretch contains,
    with one place where it occurs.  ``asked`` is over ``doc_id`` and ``text``."""
    if min_length < 1:
        raise ValueError("min_length must be positive")
    gram = 1 << min(min_length, 32).bit_length() - 1
    texts = write_table(docs.select("doc_id", "text", F.coalesce(asked, F.lit(False)).alias("asked")).filter(F.length("text") >= min_length).withColumn("at", F.monotonically_increasing_id()), "texts")
    runs, units = _units(_runs(texts, gram, min_length - gram + 1))
    # one of several texts is another text than any
    apart = units.select("at", "text", F.when(F.col("lo.doc") == F.col("hi.doc"), F.col("lo.doc")).otherwise(-1 - F.col("at")).alias("doc"), "asked")
    few = (units.agg(F.sum(F.length("text"))).first()[0] or 0) <= _FEW
    best = _in_order(apart, min_length) if few else _longest(apart, min_length)
    place = lambda c: F.struct(F.col(f"{c}.doc").alias("doc"), F.col(f"{c}.start").alias("start"))
    ends = units.select("at", F.col("at").alias("at2"), place("lo").alias("lo"), place("hi").alias("hi"), F.length("text").cast("int").alias("size"))
    one = runs.filter("asked").select(F.col("at").alias("at1"), "doc", "start")
    single = best.join(one, "at1").join(ends.drop("at", "size"), "at2")
    # all of a run that another text has
    shared = one.join(ends.filter("lo.doc <> hi.doc"), F.col("at1") == F.col("at")).filter(F.col("size") >= min_length).select("at1", F.lit(0).cast("long").alias("pos1"), F.col("size").alias("lcp"), "at2", F.lit(0).cast("long").alias("pos2"), "doc", "start", "lo", "hi")
    both = single.select(*shared.columns).unionByName(shared).withColumn("other", F.when(F.col("lo.doc") == F.col("doc"), F.col("hi")).otherwise(F.col("lo")))
    matched = write_table(both.select("doc", (F.col("start") + F.col("pos1")).alias("position"), F.col("lcp").alias("length"), F.col("other.doc").alias("doc2"), (F.col("other.start") + F.col("pos2")).alias("other_position")), "matched")
    # one that starts a character earlier and ends at the same place contains it
    wider = matched.select("doc", (F.col("position") + 1).alias("position"), (F.col("length") - 1).alias("length"))
    widest = matched.join(wider, ["doc", "position", "length"], "left_anti")
    ids = texts.select("at", "doc_id")
    named = widest.join(ids.toDF("doc", "doc_id"), "doc").join(ids.toDF("doc2", "other_id"), "doc2")
    return named.select("doc_id", F.col("position").cast("int").alias("position"), "length", "other_id", F.col("other_position").cast("int").alias("other_position"))
