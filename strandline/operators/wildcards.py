"""Wildcard search of many patterns at once.

A pattern is cut at its ``*`` into parts, and of each part the longest run without a
``?`` is its anchor.  One pass over the texts tells which of them may have the longest anchor
of which patterns (:func:`strandline.plans.gram_index.having`), one row a text and pattern
and none a hit.  Each text then meets its patterns once, and a worker follows the chains
of each through the text: a step's searches go on where the last one ended, so a pattern
passes a text once a part, however many hits it has.

Texts beyond ``MAX_CHARS`` are many tasks' work.  All anchors are found in them
(:func:`strandline.plans.gram_index.occurrences`) and compared with slices, so that a hit far
into a text costs no more than one at its beginning.  Then the hits of a pattern's parts are merged by
position, one merge a gap for all patterns together (:mod:`strandline.plans.asof`).
There stop characters are counted, not searched: a gap has none if as many stand before its
end as before its start.  A part of ``?`` alone lies as near as the gap allows, which
makes the next gap longer, or the match.

Defined cases: null and empty patterns, those of ``*`` alone, and null and empty texts match
nothing; patterns without a literal match almost everywhere, at most ``OPEN`` of them; rows
with null or repeated ids are texts, and patterns, of their own; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.patterns import WildcardOptions, quote
from strandline.operators.search import _ends, _let
from strandline.operators.suffix import MAX_CHARS
from strandline.plans import asof
from strandline.plans.gram_index import having, occurrences
from strandline.plans.keys import by_row
from strandline.plans.tables import write_table

#: Most patterns of a call that have no literal at all.
OPEN = 1000
#: Characters of a slice at least, since stop characters are counted in it for every hit;
#: never fewer than a part and what must follow it.
SLICE = 256
#: Patterns that a text meets in one row, about so many at most.
TOGETHER = 64
#: Rows that a worker hands over at a time, and those of one pattern more.
_ROWS = 1 << 15
_PARTS = "pid long, k int, of int, size int, anchor string, offset int, like string, least long, most long, tail long"
_NEXT = "struct<at:bigint,end:bigint,from:bigint,to:bigint,least:bigint,most:bigint,of:int,tail:bigint>"
_ON_THE_WAY = ["position", "end", "to", "least", "most", "of", "tail"]


def parts_of(pattern: str, o: WildcardOptions) -> list[tuple]:
    """``(k, of, size, anchor, offset, like, least, most, tail)`` of each part with a
    literal, and of the first one: its anchor and where that stands, an expression if it has
    ``?``, bounds of the gap behind it, and the characters that must follow the last one."""
    parts, found, behind = [p for p in pattern.split(o.asterisk) if p], [], 0
    for i, part in enumerate(parts):
        runs = part.split(o.question)
        whole, open_ = len(runs) == 1, not any(runs)
        if i and open_:
            behind += o.asterisk_min_length + len(part)
            continue
        if not (i == 0 and (whole or open_)) and any(c in o.stop_characters for run in runs for c in run):
            return []
        if found:
            found[-1] += [behind + o.asterisk_min_length, behind + o.asterisk_max_length]
            behind = 0
        longest = max(range(len(runs)), key=lambda j: len(runs[j]))
        any_one = f"[^{quote(o.stop_characters)}]" if o.stop_characters else "."
        like = None if whole or open_ else "(?s)^" + any_one.join(quote(r) for r in runs) + "$"
        found.append([len(part), runs[longest], sum(len(r) + 1 for r in runs[:longest]), like])
    if found:
        found[-1] += [0, 0]
    return [(k, len(found), *f, behind if k == len(found) - 1 else 0) for k, f in enumerate(found)]


def _stops(text: Column, o: WildcardOptions) -> Column:
    """How many stop characters a text has."""
    if not o.stop_characters:
        return F.lit(0)
    return F.length(text) - F.length(F.translate(text, o.stop_characters, ""))


def _slices(docs: DataFrame, size: int, reach: int, o: WildcardOptions) -> DataFrame:
    """``(doc_id, block, slice, before)``: ``size`` characters of a text, ``reach`` more that
    follow, and the number of stop characters in front."""

    def cut(pieces: Column) -> Column:
        ends = _ends(F.transform(pieces, lambda p: _stops(p, o)))
        return _let(ends, lambda e: F.transform(pieces, lambda p, i: F.struct(i.alias("block"), F.concat(p, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, reach)).alias("slice"), F.coalesce(F.get(e, i - 1), F.lit(0)).alias("before"))))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select("doc_id", F.inline(_let(pieces, cut)))


@by_row
def search_wildcard_each(docs: DataFrame, patterns: DataFrame, options: WildcardOptions | None = None, block: int | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """``patterns(qid, pattern)`` to ``(qid, doc_id, position, length)``: for each pattern
    what :func:`strandline.operators.search.search_wildcard` finds.  ``block`` and
    ``max_chars`` are of texts that are many tasks' work."""
    o = options or WildcardOptions()
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    asked = write_table(patterns.select("qid", "pattern").withColumn("pid", F.monotonically_increasing_id()), "patterns")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PARTS.split(", ")]
        for b in batches:
            rows = [(pid, *part) for pid, pattern in zip(*[c.to_pylist() for c in b.columns]) for part in parts_of(pattern, o)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, _PARTS.split(", "))]))

    parts = write_table(asked.filter(F.length("pattern") > 0).select("pid", "pattern").mapInArrow(parse, _PARTS), "parts")
    alone = [r[0] for r in parts.filter("anchor = '' and of = 1").select("pid").limit(OPEN + 1).collect()]
    if len(alone) > OPEN:
        raise ValueError(f"more than {OPEN} patterns have no literal")
    found = _in_texts(texts.filter(F.length("text") <= max_chars), asked, parts, alone, o)
    giant = texts.filter(F.length("text") > max_chars)
    if giant.take(1):
        found = found.union(_by_merges(giant, parts, alone, o, block))
    return found.join(asked.select("pid", "qid"), "pid").select("qid", "doc_id", "position", "length")


@lru_cache(4096)
def _steps(pattern: str, o: WildcardOptions) -> tuple[tuple[str, ...], list[tuple]]:
    """The anchors of a pattern, and ``(search, size, tail, least, most)`` of each part with
    a literal and of the first one; the gap is that before the part."""
    found, gap = [], (0, 0)
    any_one = f"[^{re.escape(o.stop_characters)}]" if o.stop_characters else "."
    first, *others = [p for p in pattern.split(o.asterisk) if p]
    literal = [first, *[p for p in others if p.strip(o.question)]]
    parts = parts_of(pattern, o)
    for text, (k, _, size, anchor, _, _, least, most, tail) in zip(literal, parts):
        free = k == 0 and not text.strip(o.question)
        signs = [("." if free else any_one) if c == o.question else re.escape(c) for c in text]
        behind = f"(?={any_one}{{{tail}}})" if tail else ""
        found.append((re.compile("(?s)" + "".join(signs) + behind).search, size, tail, *gap))
        gap = (least, most)
    return tuple(p[3] for p in parts if p[3]), found


def _chains(text: str, pattern: str, o: WildcardOptions) -> list[tuple[int, int]]:
    """``(position, length)`` of every match of a pattern in a text."""
    anchors, steps = _steps(pattern, o)
    if not steps or not all(a in text for a in anchors):
        return []
    search, size = steps[0][:2]
    way, hit = [], search(text, 0)
    while hit:
        way.append((hit.start(), hit.start() + size))
        hit = search(text, hit.start() + 1)
    stop = re.compile(f"[{re.escape(o.stop_characters)}]").search if o.stop_characters else None
    for search, size, tail, least, most in steps[1:]:
        # ends grow along the way, so what was searched once is not searched again
        on, at, sought, stopped = [], -1, 0, -1
        for start, end in way:
            if stop and stopped < end:
                stopped = m.start() if (m := stop(text, end)) else len(text)
            lo = end + least
            until = min(end + most + size + tail, stopped if stop else len(text))
            if at < lo:
                m = search(text, max(lo, sought), until) if until - max(lo, sought) >= size + tail else None
                if m is None:
                    sought = max(sought, until - size - tail + 1)
                    continue
                at = m.start()
            if at + size + tail <= until:
                on.append((start, at + size))
        way = on
    tail = steps[-1][2]
    return [(start, end + tail - start) for start, end in way]


def _in_texts(texts: DataFrame, asked: DataFrame, parts: DataFrame, alone: list[int], o: WildcardOptions) -> DataFrame:
    """``(pid, doc_id, position, length)``: each text with the patterns whose longest anchor
    it may have."""
    rows = texts.select(F.col("doc_id.row").alias("row"), "doc_id", "text")
    probe = parts.filter("anchor <> ''").groupBy("pid").agg(F.max_by("anchor", F.length("anchor")).alias("anchor"))
    literals = probe.select(F.col("anchor").alias("qid"), F.col("anchor").alias("pattern")).distinct()
    met = having(rows.select("row", "text"), literals).join(probe.withColumnRenamed("anchor", "qid"), "qid").select("row", "pid")
    if alone:
        met = met.union(rows.select("row", F.explode(F.lit(alone)).alias("pid")))
    groups = F.greatest(F.lit(1), F.ceil(F.lit(asked.count() / TOGETHER)))
    dealt = met.join(asked.select("pid", "pattern"), "pid").groupBy("row", F.pmod(F.xxhash64("pid"), groups).alias("__group")).agg(F.collect_list(F.struct("pid", "pattern")).alias("asked"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, pids, places, sizes = [], [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                for one in b.column(2)[i].as_py():
                    for position, length in _chains(text, one["pattern"], o):
                        owner.append(i)
                        pids.append(one["pid"])
                        places.append(position)
                        sizes.append(length)
                    if len(owner) >= _ROWS:
                        yield out(b, owner, pids, places, sizes)
                        owner, pids, places, sizes = [], [], [], []
            if owner:
                yield out(b, owner, pids, places, sizes)

    def out(b: pa.RecordBatch, owner: list, pids: list, places: list, sizes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), b.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], names=["pid", "doc_id", "position", "length"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return dealt.join(rows, "row").select("doc_id", "text", "asked").mapInArrow(follow, f"pid long, doc_id {kind}, position int, length int")


def _by_merges(texts: DataFrame, parts: DataFrame, alone: list[int], o: WildcardOptions, block: int | None) -> DataFrame:
    """``(pid, doc_id, position, length)`` by joins and merges of the parts' hits."""
    hits = write_table(_part_hits(texts, parts, alone, o), "part-hits")
    steps = hits.agg(F.max("of")).first()[0] or 0
    way = hits.filter("k = 0").withColumn("position", F.col("at")).select("doc_id", "pid", *_ON_THE_WAY)
    done = [way.filter("of = 1")]
    for k in range(1, steps):
        way = write_table(_step(way.filter(F.col("of") > k), hits.filter(F.col("k") == k), block), "chains")
        done.append(way.filter(F.col("of") == k + 1))
    length = F.col("end") + F.col("tail") - F.col("position")
    return reduce(DataFrame.union, done).select("pid", "doc_id", F.col("position").cast("int").alias("position"), length.cast("int").alias("length"))


def _part_hits(texts: DataFrame, parts: DataFrame, alone: list[int], o: WildcardOptions) -> DataFrame:
    """Hits of the parts, in texts that have all anchors of a pattern: ``(doc_id, pid, k, of,
    at, end, from, to, least, most, tail)``, with the stop characters before both ends."""
    anchored = parts.filter("anchor <> ''")
    literals = anchored.select(F.col("anchor").alias("qid"), F.col("anchor").alias("pattern")).distinct()
    found = write_table(occurrences(texts, literals).withColumnRenamed("qid", "anchor"), "anchor-hits")
    # texts are told by the anchors they have before any hit is told apart by pattern
    has = found.select("doc_id", "anchor").distinct().join(anchored.groupBy("anchor", "pid").agg(F.count(F.lit(1)).alias("n")), "anchor").groupBy("doc_id", "pid").agg(F.sum("n").alias("has"))
    needed = anchored.groupBy("pid").agg(F.count(F.lit(1)).alias("needed"))
    whole = write_table(has.join(needed, "pid").filter("has = needed").select("doc_id", "pid"), "whole")
    at = (F.col("position") - F.col("offset")).cast("long").alias("at")
    kept = found.join(anchored.select("anchor", "pid", "k", "offset"), "anchor").join(whole, ["doc_id", "pid"], "left_semi").select("doc_id", "pid", "k", at).filter("at >= 0")
    # a first part of ? alone stands everywhere, in the texts that have the rest
    first = parts.filter("anchor = ''").select("pid", "size", "of")
    free = whole
    if alone:
        free = free.union(texts.select("doc_id", F.explode(F.lit(alone)).alias("pid")))
    free = free.join(first, "pid").join(texts.select("doc_id", F.length("text").alias("n")), "doc_id").filter("n >= size")
    places = free.select("doc_id", "pid", F.lit(0).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - F.col("size")).cast("long"))).alias("at"))
    reach = parts.agg(F.max(F.col("size") + F.col("tail"))).first()[0] or 0
    size = max(SLICE, reach)
    some = texts if alone else texts.join(whole.select("doc_id").distinct(), "doc_id", "left_semi")
    placed = kept.unionByName(places).withColumn("block", F.floor(F.col("at") / size).cast("int")).withColumn("off", (F.col("at") % size).cast("int"))
    met = placed.join(parts.drop("anchor", "offset"), ["pid", "k"]).join(_slices(some, size, reach, o), ["doc_id", "block"])
    text, off, n = F.col("slice"), F.col("off"), F.col("size")
    fits = off + n + F.col("tail") <= F.length(text)
    same = F.col("like").isNull() | F.rlike(F.substring(text, off + 1, n), F.col("like"))
    clear = (F.col("tail") == 0) | (_stops(F.substring(text, off + n + 1, F.col("tail").cast("int")), o) == 0)
    before = lambda to: (F.col("before") + _stops(F.substring(text, F.lit(1), to), o)).cast("long")
    return met.filter(fits & same & clear).select("doc_id", "pid", "k", "of", "at", (F.col("at") + n).alias("end"), before(off).alias("from"), before(off + n).alias("to"), "least", "most", "tail")


def _step(way: DataFrame, hits: DataFrame, block: int | None) -> DataFrame:
    """Each chain goes on at the nearest hit of the next part that its gap admits."""
    so_far = F.struct("position", "end", "to", "most")
    kind = way.select(so_far.alias("s")).schema["s"].dataType
    one = way.select("doc_id", "pid", so_far.alias("so_far"), (F.col("end") + F.col("least")).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(_NEXT).alias("hit"))
    hit = F.struct("at", "end", "from", "to", "least", "most", "of", "tail").cast(_NEXT)
    two = hits.select("doc_id", "pid", F.lit(None).cast(kind).alias("so_far"), F.col("at").alias("__at"), F.lit(1).alias("__kind"), hit.alias("hit"))
    merged = asof.running(one.unionByName(two), ["doc_id", "pid"], "__at", "__kind", F.col("hit"), "next", largest=False, backward=True, block=block)
    on = merged.filter((F.col("__kind") == 0) & (F.col("next.at") - F.col("so_far.end") <= F.col("so_far.most")) & (F.col("next.from") == F.col("so_far.to")))
    return on.select("doc_id", "pid", "so_far.position", "next.end", "next.to", "next.least", "next.most", "next.of", "next.tail")
