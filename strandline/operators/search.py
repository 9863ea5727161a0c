"""Search in texts ``(doc_id, text)``: exact, wildcard, gapped and fuzzy.

Positions count code points from 0; occurrences may overlap; an empty pattern
occurs nowhere.  Expressions stay in the JVM: a text is split before every
match, so the pieces' lengths add up to the positions.  Hits of the parts of gapped
patterns are rows that are merged by position (:mod:`strandline.plans.asof`).

Defined cases, of all operators: a null text has no hits (``contains``, ``find_first``,
``count_occurrences``: a row with null); an empty text has none either, and 0; rows
with null or repeated ids are texts of their own, each with its hits; empty tables
give no rows; other columns are not read.  :func:`snippets` alone joins by id: a hit
meets every text of its id, null for null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.functions.patterns import WildcardOptions, fixed, quote, wildcard
from strandline.plans import asof
from strandline.plans.keys import by_row
from strandline.plans.tables import write_table


class SortOrder(Enum):
    UNORDERED = 0
    ASCENDING = 1
    DESCENDING = 2


def _sorted(df: DataFrame, order: SortOrder, *columns: str) -> DataFrame:
    if not isinstance(order, SortOrder):
        raise ValueError("order must be a SortOrder")
    if order is SortOrder.UNORDERED:
        return df
    return df.orderBy(*[F.asc(c) if order is SortOrder.ASCENDING else F.desc(c) for c in columns])


#: Pieces of a text whose ends are added up at a time.
_RUN = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(lengths: Column) -> Column:
    """Running sums of an array, run by run, so that none is copied at every element."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    none = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("all"))
        return F.aggregate(part, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")))["all"]

    def of(whole: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(_RUN))
        runs = F.transform(cuts, lambda c: F.slice(whole, c, F.lit(_RUN)))
        return _let(runs, lambda r: _let(sums(F.transform(r, total), F.lit(0)), lambda after: F.flatten(F.transform(r, lambda part, k: sums(part, F.coalesce(F.get(after, k - 1), F.lit(0)))))))

    return _let(lengths, of)


def starts_of(text: Column, expression: str) -> Column:
    """Positions, ascending, at which a regular expression matches."""
    ahead = F.split(text, f"(?s)(?={expression})", -1)
    # a match at 0 yields no piece of its own
    at_zero = F.when(text.rlike(f"(?s)^(?:{expression})"), F.array(F.lit(0)))
    lengths = _let(ahead, lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), F.length))
    return F.concat(F.coalesce(at_zero, F.array().cast("array<int>")), _ends(lengths))


def count_of(text: Column, pattern: str) -> Column:
    """Overlapping occurrences of a literal."""
    if not pattern:
        return F.lit(0)
    n = F.size(F.split(text, f"(?={quote(pattern)})", -1)) - 1 + F.startswith(text, F.lit(pattern)).cast("int")
    return F.when(text.isNotNull(), n)


def contains(docs: DataFrame, pattern: str) -> DataFrame:
    """``(doc_id, found)``."""
    found = F.contains(F.col("text"), F.lit(pattern)) if pattern else F.lit(False)
    return docs.select("doc_id", found.alias("found"))


def find_first(docs: DataFrame, pattern: str) -> DataFrame:
    """``(doc_id, position)`` of the first occurrence; null if there is none."""
    first = F.nullif(F.instr("text", pattern), F.lit(0)) - 1 if pattern else F.lit(None).cast("int")
    return docs.select("doc_id", first.alias("position"))


def count_occurrences(docs: DataFrame, pattern: str) -> DataFrame:
    """``(doc_id, count)``; texts without an occurrence have 0."""
    return docs.select("doc_id", count_of(F.col("text"), pattern).alias("count"))


def locate(docs: DataFrame, pattern: str, order: SortOrder = SortOrder.UNORDERED) -> DataFrame:
    """``(doc_id, position)`` of every occurrence of a literal."""
    return _sorted(_explode_starts(docs, pattern and quote(pattern), F.contains(F.col("text"), F.lit(pattern))), order, "doc_id", "position")


def _explode_starts(docs: DataFrame, expression: str, likely: Column) -> DataFrame:
    if not expression:
        return docs.filter(F.lit(False)).select("doc_id", F.lit(0).alias("position"))
    return docs.filter(likely).select("doc_id", F.explode(starts_of(F.col("text"), expression)).alias("position"))


def locate_each(docs: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """``(doc_id, pattern, position)`` for several literals in one pass over the texts."""
    patterns = [p for p in dict.fromkeys(patterns) if p]
    per = [F.when(F.contains(F.col("text"), F.lit(p)), F.struct(F.lit(p).alias("pattern"), starts_of(F.col("text"), quote(p)).alias("at"))) for p in patterns]
    if not per:
        return docs.filter(F.lit(False)).select("doc_id", F.lit("").alias("pattern"), F.lit(0).alias("position"))
    found = docs.select("doc_id", F.explode(F.filter(F.array(*per), lambda x: x.isNotNull())).alias("f"))
    return found.select("doc_id", "f.pattern", F.explode("f.at").alias("position"))


def _longest_literal(parts: Iterable[str]) -> Column:
    best = max(parts, key=len, default="")
    return F.contains(F.col("text"), F.lit(best)) if best else F.lit(True)


def locate_wildcard(docs: DataFrame, pattern: str, wild: str = "?", order: SortOrder = SortOrder.UNORDERED) -> DataFrame:
    """Positions of a pattern in which ``wild`` stands for any one character."""
    return _sorted(_explode_starts(docs, fixed(pattern, wild), _longest_literal(pattern.split(wild))), order, "doc_id", "position")


def search_wildcard(docs: DataFrame, pattern: str, options: WildcardOptions | None = None) -> DataFrame:
    """``(doc_id, position, length)``: every start, with each ``*`` as short as possible."""
    o = options or WildcardOptions()
    rx = wildcard(pattern, o)
    if rx is None:
        return docs.filter(F.lit(False)).select("doc_id", F.lit(0).alias("position"), F.lit(0).alias("length"))
    likely = _longest_literal(pattern.replace(o.asterisk, o.question).split(o.question))
    lengths = F.transform(F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=({rx}))"), F.lit(1)), F.length)
    both = F.arrays_zip(starts_of(F.col("text"), rx).alias("position"), lengths.alias("length"))
    return docs.filter(likely).select("doc_id", F.inline(both))


def _apart(asterisk: str, question: str) -> None:
    if len(asterisk) != 1 or len(question) != 1 or asterisk == question:
        raise ValueError("the two wildcards must be different single characters")


def _part_hits(docs: DataFrame, parts: list[str], question: str) -> list[DataFrame]:
    """For each part of a pattern ``(doc_id, place, position)`` of its hits, numbered
    within a text; found in one pass over the texts that may have all of them."""
    likely = F.lit(True)
    for p in parts:
        likely = likely & _longest_literal(p.split(question))
    found = docs.filter(likely).select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), starts_of(F.col("text"), fixed(p, question)).alias("at")) for i, p in enumerate(parts)])).alias("h"))
    hits = write_table(found.select("doc_id", "h.part", F.posexplode("h.at").alias("place", "position")), "hits")
    return [hits.filter(F.col("part") == i).drop("part") for i in range(len(parts))]


def locate_single_gapped(docs: DataFrame, pattern: str, asterisk: str = "*", question: str = "?", block: int | None = None) -> DataFrame:
    """``(doc_id, position, length, gap_start, gap_count)`` for at most one ``*``.

    Leading and trailing hits are paired in order, each trailing hit once, with
    a gap of at least one character.  The k-th leading hit takes the trailing
    hit number k + max(f_j - j) over j <= k, where f_j counts the trailing hits
    that come too early for leading hit j: f by merging both kinds of hits by
    position, then one running maximum.
    """
    _apart(asterisk, question)
    if pattern.count(asterisk) > 1:
        raise ValueError("the pattern must have at most one gap")
    text = F.col("text")
    if asterisk not in pattern:
        hits = _explode_starts(docs, fixed(pattern, question), _longest_literal(pattern.split(question)))
        return hits.select("doc_id", "position", F.lit(len(pattern)).alias("length"), F.lit(0).alias("gap_start"), F.lit(0).alias("gap_count"))
    lead, trail = pattern.split(asterisk)
    n = F.length(text)
    if not lead and not trail:
        return docs.select("doc_id", F.lit(0).alias("position"), n.alias("length"), F.lit(0).alias("gap_start"), n.alias("gap_count"))
    if not trail:
        hits = docs.select("doc_id", n.alias("n"), F.explode(starts_of(text, fixed(lead, question))).alias("position"))
        return hits.select("doc_id", "position", (F.col("n") - F.col("position")).alias("length"), F.lit(len(lead)).alias("gap_start"), (F.col("n") - F.col("position") - len(lead)).alias("gap_count"))
    if not lead:
        hits = docs.select("doc_id", F.explode(starts_of(text, fixed(trail, question))).alias("at"))
        return hits.select("doc_id", F.lit(0).alias("position"), (F.col("at") + len(trail)).alias("length"), F.lit(0).alias("gap_start"), F.col("at").alias("gap_count"))
    return _paired(docs, lead, trail, question, block)


@by_row
def _paired(docs: DataFrame, lead: str, trail: str, question: str, block: int | None) -> DataFrame:
    leads, trails = _part_hits(docs, [lead, trail], question)
    # a trailing hit at the end of the leading part comes first there: it is too early
    one = leads.select("doc_id", "place", "position", (F.col("position") + len(lead)).alias("at"), F.lit(1).alias("kind"))
    two = trails.select("doc_id", "place", "position", F.col("position").alias("at"), F.lit(0).alias("kind"))
    merged = asof.running(one.unionByName(two), ["doc_id"], "at", "kind", F.when(F.col("kind") == 0, F.col("place") + 1), "early", block=block)
    rated = merged.filter("kind = 1").select("doc_id", "place", "position", (F.coalesce("early", F.lit(0)) - F.col("place")).alias("lag"))
    shifted = asof.running(rated, ["doc_id"], "place", "position", F.col("lag"), "shift", block=block)
    chosen = shifted.select("doc_id", "position", (F.col("place") + F.col("shift")).alias("place"))
    paired = chosen.join(trails.select("doc_id", "place", F.col("position").alias("t")), ["doc_id", "place"])
    return paired.select("doc_id", "position", (F.col("t") + len(trail) - F.col("position")).alias("length"), F.lit(len(lead)).alias("gap_start"), (F.col("t") - F.col("position") - len(lead)).alias("gap_count"))


_GAPS = "array<struct<position:int,length:int,gap_start:int,gap_count:int>>"


def locate_multi_gapped(docs: DataFrame, pattern: str, find_shortest: bool = True, asterisk: str = "*", question: str = "?", block: int | None = None) -> DataFrame:
    """``(doc_id, position, length, gaps)`` for any number of ``*``.

    ``find_shortest``: for each hit of the first part the nearest chain, one merge of
    hits a gap; else every combination, whose number is that of the rows returned.
    Gaps may be empty; ``gaps`` lists for each its (position, length, gap_start,
    gap_count), gap_start relative to position.
    """
    _apart(asterisk, question)
    parts = [p for p in pattern.split(asterisk) if p]
    if not parts:
        return docs.filter(F.lit(False)).select("doc_id", F.lit(0).alias("position"), F.lit(0).alias("length"), F.array().cast(_GAPS).alias("gaps"))
    rows = _chains(docs, parts, question, block) if find_shortest else _combinations(docs, parts, question)
    gaps = F.array(
        *[
            F.struct(
                F.col(f"p{i}").alias("position"),
                (F.col(f"p{i + 1}") + len(parts[i + 1]) - F.col(f"p{i}")).alias("length"),
                F.lit(len(parts[i])).alias("gap_start"),
                (F.col(f"p{i + 1}") - F.col(f"p{i}") - len(parts[i])).alias("gap_count"),
            )
            for i in range(len(parts) - 1)
        ]
    ).cast(_GAPS)
    return rows.select("doc_id", F.col("p0").alias("position"), (F.col(f"p{len(parts) - 1}") + len(parts[-1]) - F.col("p0")).alias("length"), gaps.alias("gaps"))


@by_row
def _chains(docs: DataFrame, parts: list[str], question: str, block: int | None) -> DataFrame:
    first, *rest = _part_hits(docs, parts, question)
    rows = first.select("doc_id", F.col("position").alias("p0"))
    for i, hits in enumerate(rest):
        ended = rows.withColumn("__end", F.col(f"p{i}") + len(parts[i]))
        rows = asof.first_later(ended, hits, ["doc_id"], "__end", f"p{i + 1}", block).drop("__end")
    return rows


def _not_before(end: Column) -> Callable[[Column], Column]:
    return lambda x: x >= end


def _combinations(docs: DataFrame, parts: list[str], question: str) -> DataFrame:
    likely = F.lit(True)
    for p in parts:
        likely = likely & _longest_literal(p.split(question))
    hits = docs.filter(likely).select("doc_id", *[starts_of(F.col("text"), fixed(p, question)).alias(f"h{i}") for i, p in enumerate(parts)])
    rows = hits.withColumn("p0", F.explode("h0"))
    for i in range(1, len(parts)):
        end = F.col(f"p{i - 1}") + len(parts[i - 1])
        rows = rows.withColumn(f"p{i}", F.explode(F.filter(f"h{i}", _not_before(end))))
    return rows


def locate_fuzzy(
    docs: DataFrame, pattern: str, max_distance: int = 1, disable_deletion: bool = False, disable_insertion: bool = False, wild: str | None = None, order: SortOrder = SortOrder.UNORDERED
) -> DataFrame:
    """``(doc_id, position, length, edit_distance)``: for each start the best match
    within ``max_distance`` errors; of equal ones the length nearest the
    pattern's, then the shorter.

    Of a pattern cut into ``max_distance + 1`` pieces one must occur unchanged,
    which drops most texts before any leaves the JVM, and of the rest only the
    starts around such pieces are tried.
    """
    if max_distance < 0:
        raise ValueError("max_distance must not be negative")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, position int, length int, edit_distance int"
    likely, pieces = F.lit(bool(pattern)), []
    if len(pattern) > max_distance and wild is None:
        cut = [len(pattern) * k // (max_distance + 1) for k in range(max_distance + 2)]
        pieces = [(a, pattern[a:b]) for a, b in zip(cut, cut[1:])]
        likely = F.lit(False)
        for _, piece in pieces:
            likely = likely | F.contains(F.col("text"), F.lit(piece))
    codes, sign = kernels.code_points(pattern), None if wild is None else ord(wild)
    starts = lambda text: kernels.near_hits(text, pieces, max_distance) if pieces else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = kernels.fuzzy_each(b.column(1).to_pylist(), starts, codes, max_distance, not disable_deletion, not disable_insertion, sign)
            for rows, at, size, far in found:
                numbers = [pa.array(c.astype("int32")) for c in (at, size, far)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *numbers], names=["doc_id", "position", "length", "edit_distance"])

    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & likely).mapInArrow(run, schema)
    return _sorted(found, order, "doc_id", "position")


def snippet(text: Column, position: Column, key_length: Column, total_length: int, leading_ratio: float = 0.5) -> Column:
    """Struct (text, index, length, key_position): a window of the text around a
    key, moved where it would leave the text.  The leading share is rounded half
    to even."""
    if total_length <= 0 or not 0 <= leading_ratio <= 1:
        raise ValueError("total_length must be positive and leading_ratio between 0 and 1")
    n = F.length(text)
    context = F.lit(total_length) - key_length
    lead = F.bround(context.cast("double") * leading_ratio).cast("int")
    start0 = position - lead
    start1 = F.greatest(start0, F.lit(0))
    end0 = position + key_length + (context - lead) + (start1 - start0)
    over = F.greatest(end0 - n, F.lit(0))
    start, end = F.greatest(start1 - over, F.lit(0)), F.least(end0, n)
    short = key_length >= total_length
    index = F.when(short, position).otherwise(start).cast("int")
    length = F.when(short, F.lit(total_length)).otherwise(end - start).cast("int")
    return F.struct(F.substring(text, index + 1, length).alias("text"), index.alias("index"), length.alias("length"), F.when(short, F.lit(0)).otherwise(position - start).cast("int").alias("key_position"))


def snippets(docs: DataFrame, hits: DataFrame, total_length: int, leading_ratio: float = 0.5) -> DataFrame:
    """``hits(doc_id, position, key_length)`` with their ``text``, ``index``,
    ``length`` and ``key_position``."""
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    joined = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")))
    s = snippet(F.col("__text"), F.col("position"), F.col("key_length"), total_length, leading_ratio)
    return joined.withColumn("__s", s).select(*hits.columns, "__s.*")


def snippets_of(docs: DataFrame, pattern: str, total_length: int, leading_ratio: float = 0.5) -> DataFrame:
    """Every occurrence of a literal in context, without a join."""
    hits = docs.filter(F.contains(F.col("text"), F.lit(pattern))).select("doc_id", "text", F.explode(starts_of(F.col("text"), quote(pattern))).alias("position"))
    s = snippet(F.col("text"), F.col("position"), F.lit(len(pattern)), total_length, leading_ratio)
    return hits.select("doc_id", "position", s.alias("s")).select("doc_id", "position", F.col("s.text").alias("snippet"), "s.index", "s.length", "s.key_position")
