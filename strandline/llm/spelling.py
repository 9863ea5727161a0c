"""Spelling variants: words of a corpus one edit apart.

Of two words that differ by one inserted, deleted or replaced code point, the
longer of L points, either the first L / 2 points or those behind them are the
same.  So each word stands in the blocks of its own length and of the next one,
by its first half in a dictionary sorted forward and by its last half in one
sorted by reversed words.  The dictionaries are dealt out by ranges of (length,
half), so a block is one run of a sorted partition, and the scan of a run compares
its words.  The edit lies in what a run's words do not share; the common beginning
of the two words says where, and the pair is told by the run whose window holds
that place, by the reversed dictionary only if the forward one does not: once.

A block larger than ``BLOCK`` words is subdivided before it is dealt out: each half
of its window makes a block of its own, whose words share the other half as well.
A window of one place holds no more words than there are letters.  Sizes come from
counts combined before their shuffle; the names of large blocks, which are at most
``MOST_LARGE`` hashes whatever the dictionary's size, are broadcast.  In a worker
runs are subdivided in the same way until a few words are left.

Words are counted in the workers, in tables of at most ``HELD`` words.

Defined cases: a null or empty text has no words; a null id counts as empty
text in the hash that decides which letter goes; rows that repeat count again; very
long words are like others; empty tables give no rows; further columns of the input
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.workspace import Batches, Workspace, text_steps, worker

#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A letter of one run in so many goes, by the hash of document and run.
SLIP = 97
#: Times a word's occurrences that its form's are at least.
FORM_RATIO = 2
#: Words of a worker's table, and its code points.
HELD, HELD_CHARS = 200_000, 20_000_000
#: Words of a block that one task scans, and most blocks above it (the bound rises instead).
BLOCK, MOST_LARGE = 4096, 1 << 17
#: Words that are compared with each other without subdividing them.
FEW = 8

_RUNS = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_KEY = ["side", "length", "lo", "hi"]


def slip(doc_id: str, run: str) -> str:
    """The lower-cased run, without one of its letters where the hash says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: distinct words of at least ``LEAST_LENGTH`` code points with at
    least ``LEAST_COUNT`` occurrences in all texts."""

    def run(batches: Batches) -> Batches:
        held: Counter[str] = Counter()
        chars = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in text_steps(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for w, n in Counter(_RUNS.findall(text)).items():
                    if len(w) >= LEAST_LENGTH:  # a shorter one has no word
                        own[w.lower() if w.isascii() else w.translate(_LOWER)] += n
                for w, n in own.items():
                    word = slip(doc_id, w)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                        chars += len(word)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield told()
                    held.clear()
                    chars = 0
        if held:
            yield told()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").filter(F.length("text") > 0)
    counted = texts.mapInArrow(worker(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _entries(dictionary: DataFrame) -> DataFrame:
    """Every word in the blocks of two lengths, forward and reversed; the window that
    a block's words do not share is ``[lo, hi)``."""
    n = F.length("word")
    both = F.array(*[F.struct(F.lit(side).alias("side"), (n + more).alias("length")) for side in (0, 1) for more in (0, 1)])
    rows = dictionary.select("word", "n", F.explode(both).alias("e")).select("word", "n", "e.side", "e.length")
    half = F.floor(F.col("length") / 2)
    lo = F.when(F.col("side") == 0, half).otherwise(F.col("length") - half).cast("int")
    return rows.select("side", "length", lo.alias("lo"), F.col("length").alias("hi"), F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"), "n")


def _shared(rows: DataFrame) -> DataFrame:
    """Adds ``head`` and ``tail``, what a block's words have in common."""
    tail = F.expr("substring(word, length(word) - (length - hi) + 1, length - hi)")
    return rows.withColumn("head", F.expr("substring(word, 1, lo)")).withColumn("tail", tail)


def _subdivided(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    windows = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("side", "length", "word", "n", F.explode(windows).alias("w")).select("side", "length", "w.lo", "w.hi", "word", "n")


def _blocks(dictionary: DataFrame, block: int, space: Workspace) -> list[DataFrame]:
    """Tables of entries whose blocks have at most ``block`` words or one place."""
    rows, out = _entries(dictionary), []
    most = max(block, 4 * dictionary.count() // MOST_LARGE)
    while True:
        named = _shared(rows).withColumn("block", F.xxhash64(*_KEY, "head", "tail")).drop("head", "tail")
        sizes = named.filter("hi - lo > 1").groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        large = space.save(sizes.filter(F.col("size") > most).select("block"), "large")
        if large.isEmpty():
            return [*out, rows]
        marked = named.join(F.broadcast(large.withColumn("large", F.lit(True))), "block", "left")
        split = marked.filter("large and hi - lo > 1")
        out.append(marked.filter("large is null or hi - lo <= 1").select(*rows.columns))
        rows = space.save(_subdivided(split), "subdivided")


def _lcp(a: str, b: str, start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def _one_edit(a: str, b: str, length: int, lo: int) -> int:
    """Where the longer of two different words, of the given length, was edited; -1 if
    they are further apart.  The first ``lo`` points are known to be equal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) != length:
        return -1
    p = _lcp(a, b, lo)
    return p if a[p + 1 :] == b[p + (len(a) == len(b)) :] else -1


def near_in_block(block: list[tuple[str, int]], side: int, length: int, lo: int, hi: int) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of a block, each with both words' counts, whose edit is in the window."""
    if len(block) < 2:
        return
    if len(block) <= FEW or hi - lo <= 1:
        for i, (a, n) in enumerate(block):
            for b, m in block[:i]:
                p = _one_edit(a, b, length, lo)
                if lo <= p < hi:
                    if side and _lcp(a[::-1], b[::-1]) >= length // 2:
                        continue  # the forward dictionary has them
                    yield (a[::-1], n, b[::-1], m) if side else (a, n, b, m)
        return
    middle = (lo + hi) // 2
    for low, high in ((lo, middle), (middle, hi)):
        parts = defaultdict(list)
        for w in block:
            parts[w[0][len(w[0]) - (length - high) :] if high < hi else w[0][:low]].append(w)
        for part in parts.values():
            yield from near_in_block(part, side, length, low, high)


def near_pairs(dictionary: DataFrame, block: int = BLOCK, space: Workspace | None = None) -> DataFrame:
    """``dictionary(word, n)`` of distinct words to ``(word, n, near, near_n)``, once for
    each two words that are one edit apart."""
    space = space or Workspace(dictionary.sparkSession, "spelling")

    def told(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])

    def scan(batches: Batches) -> Batches:
        key, words, found = None, [], []
        for b in batches:
            for side, length, lo, hi, word, n in zip(*[c.to_pylist() for c in b.columns]):
                own = (side, length, lo, hi, word[:lo], word[len(word) - (length - hi) :] if hi < length else "")
                if own != key:
                    if len(words) > 1:
                        found += near_in_block(words, *key[:4])
                        if len(found) > 50_000:
                            yield told(found)
                            found = []
                    key, words = own, []
                words.append((word, n))
        if len(words) > 1:
            found += near_in_block(words, *key[:4])
        yield told(found)

    def scanned(rows: DataFrame) -> DataFrame:
        order = [*_KEY, "head", "tail"]
        dealt = _shared(rows).repartitionByRange(*order).sortWithinPartitions(*order)
        return dealt.select(*rows.columns).mapInArrow(worker(scan), "word string, n long, near string, near_n long")

    first, *rest = [scanned(rows) for rows in _blocks(dictionary, block, space)]
    for more in rest:
        first = first.union(more)
    return first


def _roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``.  Counts at least double from form to form,
    so chains are as long as a logarithm, and steps that double along them a logarithm of that."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = space.save(at.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``."""
    space = Workspace(docs.sparkSession, "spelling")
    dictionary = space.save(words(docs), "words")
    pairs = space.save(near_pairs(dictionary, block, space), "pairs")
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    both = pairs.select(F.inline(ways)).select("word", "n", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")).alias("best"))
    alone = dictionary.select("word", "n", F.lit(None).cast(both.schema["best"].dataType).alias("best"))
    rated = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= FORM_RATIO * F.col("n")
    forms = space.save(rated.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form is not null").select("word", "form"), space)
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
