"""Exact Jaccard join of shingle sets in their metric space.

Distance is one minus the Jaccard similarity; two texts link when it is at most
``1 - threshold``.  Texts with equal sets are one point.

Most texts lie at distance one from any text chosen as a pivot, so pivots drawn
blindly would put everything into every window.  Pivots are therefore elected
where points can be near: a point's window is the few shingles that any partner
must share (its rarest ones among its lowest hashes, by the triangle inequality
on set differences), and each such shingle elects one of the texts that hold it.
The texts that elected the same pivot form that pivot's region; points near a
border have windows in several regions and are replicated to them, so linked
points meet in one region at least.  Inside a region points within the
threshold of the pivot hang on it; the rest is split between two further pivots
by nearness, with replicas ``2 * (1 - threshold)`` beyond the border, and joined
recursively; small or inseparable remainders are compared in blocks.  A region
too large for a task holds texts that share a common passage or are near copies:
its texts elect again, by the rarest shingles of their whole sets, which leaves a
passage out.  What is too large then goes in rounds: its chunks are compared with
the pivot; few points outside the pivot's ball are compared with all chunks, many
split the region between two pivots.  Only regions that no pivots separate are
compared block by block, and of those only blocks of sizes that can link.

Each group of linked texts leaves a spanning forest, never its pairs.  How many
links a text has is counted inside the groups afterwards: small groups whole, large
ones in bands of distance from a central point, where the triangle inequality tells
which bands are linked throughout and which cannot link; the others' blocks are
compared, each pair of blocks once.

Defined cases: null, empty and blank texts have the empty set and link with
nothing; fewer words than a shingle has: the whole sequence is one shingle;
repeated rows are copies of each other and count as links of each other; points are
named by their sets, so rows that share a ``doc_id``, or have none, link by their own texts; a group's name is
its smallest ``doc_id`` that is not null, null if there is none; empty tables give
no rows; further columns are ignored, or kept as they are.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.workspace import Batches, Recent, Workspace, finalise, text_steps, worker

#: How much longer than necessary the first window is, as a share of the set:
#: so much of a text may consist of common shingles without meeting them.
SLACK = Fraction(1, 10)
#: Most points, and most shingles, of a region or block in one task.
REGION_POINTS = 256
REGION_SHINGLES = 2_000_000
PARTS = 64
#: Bits of a map that tells which texts' sets are needed, or which shingles are common
#: (fixed size).
MAP_BITS = 1 << 24
#: One point in so many tells which shingles are common in large regions.  That only
#: orders the shingles: no link depends on it.
COMMON_SAMPLE = 16


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text.

    A-Z are lower-cased; words are runs of anything but ASCII white space."""
    # the copy matters: lower-casing a slice in place reads from the wrong offset
    own = pa.array(texts.to_pylist(), pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    flat = split.values
    lengths = np.diff(split.offsets.to_numpy())
    row = np.repeat(np.arange(len(texts)), lengths)
    coded = flat.dictionary_encode()
    known = coded.dictionary
    code = coded.indices.to_numpy()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in known.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    filled = pc.not_equal(pc.binary_length(known), 0).to_numpy(zero_copy_only=False)
    keep = filled[code] if len(code) else np.zeros(0, bool)
    w, row = h[code[keep]], row[keep]
    n = np.bincount(row, minlength=len(texts))
    start = np.cumsum(n) - n
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = []
    with np.errstate(over="ignore"):
        k = len(w) - words + 1
        acc = np.zeros(max(0, k), np.uint64)
        for i in range(words if k > 0 else 0):
            acc = acc * factor + w[i : i + k]
        acc = finalise(acc)
        for s, c in zip(start.tolist(), n.tolist()):
            if c >= words:
                out.append(np.unique(acc[s : s + c - words + 1]))
            elif c:
                short = np.uint64(c)
                for x in w[s : s + c]:
                    short = short * factor + x
                out.append(finalise(np.array([short ^ np.uint64(0xD1B54A32D192ED03)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class _Measure:
    """The threshold as integers: ``num * union <= den * intersection``."""

    def __init__(self, threshold: Fraction):
        self.num, self.den = threshold.numerator, threshold.denominator

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.den * common >= self.num * (a + b - common)) & (common > 0)


# --- inside a task -----------------------------------------------------------


class _Points:
    """Sets of one task's points, as lists of element numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[code] > 1
        names = np.cumsum(count > 1) - 1
        point = np.repeat(np.arange(len(sets)), self.n)[shared]
        self.point, self.element = point, names[code[shared]]
        self.width = int((count > 1).sum())
        self.start = np.searchsorted(point, np.arange(len(sets) + 1))

    def elements(self, i: int) -> np.ndarray:
        return self.element[self.start[i] : self.start[i + 1]]

    def with_one(self, pivot: int, idx: np.ndarray) -> np.ndarray:
        """Common elements of the pivot and each point."""
        mark = np.zeros(self.width + 1, bool)
        mark[self.elements(pivot)] = True
        hits = np.concatenate([[0], np.cumsum(mark[self.element])])
        return hits[self.start[idx + 1]] - hits[self.start[idx]]

    def products(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Common elements of every row point and every column point.

        Elements that few points have are counted pair by pair, the others by
        matrix products over strips of elements."""
        everyone = np.union1d(rows, cols)
        place = np.full(len(self.n), -1)
        place[everyone] = np.arange(len(everyone))
        use = place[self.point] >= 0
        who, what = place[self.point[use]], self.element[use]
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        head = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]])) if len(what) else np.zeros(0, int)
        size = np.diff(np.append(head, len(what)))
        m = len(everyone)
        total = np.zeros(m * m, np.float32)
        for k in range(2, 9):
            at = head[size == k]
            for i in range(k):
                for j in range(k):
                    if i != j and len(at):
                        total += np.bincount(who[at + i] * m + who[at + j], minlength=m * m)
        total = total.reshape(m, m)[np.ix_(place[rows], place[cols])]
        dense = np.flatnonzero(size > 8)
        for lo in range(0, len(dense), 4096):
            part = dense[lo : lo + 4096]
            x = np.zeros((m, len(part)), np.float32)
            take = np.repeat(head[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
            x[who[take], np.repeat(np.arange(len(part)), size[part])] = 1
            total += x[place[rows]] @ x[place[cols]].T
        return np.rint(total).astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def one(self, idx: np.ndarray) -> bool:
        return len({self.find(i) for i in idx.tolist()}) <= 1


def _block(p: _Points, rows: np.ndarray, cols: np.ndarray, measure: _Measure, forest: _Forest) -> None:
    """Links between rows and columns, found in strips."""
    for lo in range(0, len(rows), 512):
        r = rows[lo : lo + 512]
        for lc in range(0, len(cols), 512):
            c = cols[lc : lc + 512]
            common = p.products(r, c)
            i, j = np.nonzero(measure.linked(common, p.n[r][:, None], p.n[c][None, :]))
            for a, b in zip(r[i].tolist(), c[j].tolist()):
                if a != b:
                    forest.join(a, b)


def join_region(p: _Points, idx: np.ndarray, pivot: int, measure: _Measure, forest: _Forest, depth: int = 0) -> None:
    """Connects all linked points of ``idx``: the pivot's ball, then the rest by
    two pivots with replicas across the border, recursively."""
    common = p.with_one(pivot, idx)
    ball = measure.linked(common, p.n[idx], p.n[pivot])
    for x in idx[ball].tolist():
        if x != pivot:
            forest.join(pivot, x)
    far = idx[~ball & (idx != pivot)]
    if not len(far) or forest.one(idx):
        return
    if len(idx) > 64 and depth < 12:
        to_p = 1 - common / np.maximum(1, p.n[idx] + p.n[pivot] - common)
        second = int(far[np.argmax(to_p[~ball & (idx != pivot)])])
        c2 = p.with_one(second, idx)
        to_q = 1 - c2 / np.maximum(1, p.n[idx] + p.n[second] - c2)
        reach = 2 * (1 - measure.num / measure.den) + 1e-9
        near_p, near_q = idx[to_p <= to_q + reach], idx[to_q <= to_p + reach]
        if max(len(near_p), len(near_q)) <= 0.9 * len(idx):
            # the pivot's own side again, without the pivot, which is done
            rest = near_p[near_p != pivot]
            if len(rest) > 1:
                outside = rest[np.isin(rest, far)]
                join_region(p, rest, int(outside[0] if len(outside) else rest[0]), measure, forest, depth + 1)
            join_region(p, near_q, second, measure, forest, depth + 1)
            return
    _block(p, far, idx, measure, forest)


def _links(pid: np.ndarray, forest: _Forest) -> pa.Table:
    a, b = (pid[np.array([link[k] for link in forest.links], dtype=np.int64)] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


LINKS = "a long, b long"


def _points(t: pa.Table) -> tuple[np.ndarray, _Points]:
    return t["pid"].to_numpy(), _Points([np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"]])


# --- the join ------------------------------------------------------------------


def _row_keys() -> list[Column]:
    """What tells rows apart that differ in doc_id or text."""
    return [F.col("doc_id").isNull().alias("__none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.xxhash64("text").alias("__t1"), F.xxhash64(F.lit(1), "text").alias("__t2")]


_KEYS = ["__none", "__id", "__t1", "__t2"]


def _measured(docs: DataFrame, words: int, threshold: Fraction, space: Workspace) -> DataFrame:
    """Every row's keys, the size and digest of its set, and, once a task for each
    set, the lowest of its hashes: the first window."""
    window = 1 - threshold + SLACK

    @worker
    def run(batches: Batches) -> Batches:
        seen = Recent()
        for b in text_steps(batches, 1):
            n, keys, low = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                keys.append(digest(s) if len(s) else (None, None))
                if not len(s) or not seen.new(keys[-1]):  # a copy's window is not sent again
                    low.append(None)
                else:
                    low.append(s[: -(-len(s) * window.numerator // window.denominator)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(low, pa.list_(pa.int64()))],
                names=["doc_id", *_KEYS, "n", "k1", "k2", "low"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_row_keys())
    return space.save(rows.mapInArrow(run, "doc_id long, __none boolean, __id long, __t1 long, __t2 long, n long, k1 long, k2 long, low array<long>"), "measured")


def _sized(members: DataFrame, key: str, points: int | None = None) -> DataFrame:
    """Adds ``chunks``, the tasks' worth of a region (REGION_POINTS, or so many, in a task); sizes are joined by parts, so that
    no region's members meet in one task."""
    members = members.withColumn("__part", F.pmod(F.xxhash64("pid"), F.lit(PARTS)))
    parts = members.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    sizes = parts.groupBy(key).agg(F.ceil(F.greatest(F.sum("m") / (points or REGION_POINTS), F.sum("s") / REGION_SHINGLES)).cast("int").alias("chunks"))
    return members.join(parts.select(key, "__part").join(sizes, key), [key, "__part"]).drop("__part")


def _components(docs: DataFrame, words: int, threshold: Fraction, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The measured rows; ``(pid, k1, k2, n, copies, grouped, component, component_id)`` of every
    set: its rows, whether it links with another set, a number for its component and
    the smallest doc_id in it; the sets that may link."""
    measure = _Measure(threshold)
    measured = _measured(docs, words, threshold, space)
    # one point for all texts with the same set
    points = measured.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("low", ignorenulls=True).alias("low"))
    points = space.save(points.withColumn("pid", F.monotonically_increasing_id()), "points")

    # windows: the shingles that more than one point has, rarest first
    posted = points.select("pid", "n", F.explode("low").alias("h"))
    common = space.save(posted.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")  # so that AQE can split a hot shingle's postings
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * (SLACK * threshold).numerator / (SLACK * threshold).denominator).cast("int"))
    held = posted.join(common, "h").groupBy("pid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared")).filter(F.size("shared") >= least)
    held = space.save(held.select("pid", "n", F.slice("shared", F.lit(1), F.size("shared") - least + 1)["h"].alias("window")), "held")

    members = _regions(held, "", space)
    space.drop(held, common)
    # a set takes the names of its small regions along, so that it need not be joined with them again
    regions = members.groupBy("pid").agg(F.collect_list(F.when(F.col("chunks") == 1, F.struct("region", "pivot"))).alias("regions"))
    sets = _needed_sets(docs, points.select("pid", "k1", "k2", "low_id").join(regions, "pid"), words, space)

    small = sets.select("pid", "shingles", F.explode("regions").alias("r")).select("r.region", "r.pivot", "pid", "shingles")
    found, large = [], members.filter("chunks > 1")
    if large.take(1):
        some = space.save(_sets_of(large, sets), "some")
        held = _whole_windows(some, measure, space)
        again = _regions(held, "w", space)
        found = [_small_regions(again.filter("chunks = 1"), some, measure, space)]
        large = again.filter("chunks > 1")
        if large.take(1):
            found += _large_regions(large, some, measure, space)
        space.drop(held, some)
    links = _joined(small, measure, space)
    for more in found:
        links = links.union(more)
    groups = connected_components(links, space)

    linked = groups.withColumnRenamed("id", "pid").join(points.select("pid", "low_id"), "pid")
    low = linked.groupBy("component").agg(F.min("low_id").alias("component_id"))
    linked = linked.select("pid", "component").join(low, "component")
    own = points.select("pid", "k1", "k2", "n", "copies", "low_id").join(linked, "pid", "left")
    named = own.select("pid", "k1", "k2", "n", "copies", F.col("component").isNotNull().alias("grouped"), F.coalesce("component", "pid").alias("component"), F.when(F.col("component").isNull(), F.col("low_id")).otherwise(F.col("component_id")).alias("component_id"))
    return measured, named, sets


def _regions(held: DataFrame, mark: str, space: Workspace) -> DataFrame:
    """``(region, pivot, pid, n, chunks)`` from ``(pid, n, window)``: each shingle elects a
    pivot; those that elect the same one form its region, named by the pivot and a mark."""
    posted = held.select("pid", "n", F.explode("window").alias("h"))
    elected = posted.groupBy("h").agg(F.min("pid").alias("pivot"), F.max("pid").alias("other")).filter("pivot <> other").select("h", "pivot")
    elected = space.save(elected, "elected")
    members = space.save(posted.join(elected, "h").select("pivot", "pid", "n").distinct(), "regions")
    space.drop(elected)
    return space.save(_sized(members.withColumn("region", F.concat(F.col("pivot").cast("string"), F.lit(mark))), "region"), "members")


def similar_groups(docs: DataFrame, words: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_shingles, component_id (the smallest doc_id
    that links lead to, its own included) and n_links (other rows linked directly)."""
    space = Workspace(docs.sparkSession, "similar")
    measured, named, sets = _components(docs, words, threshold, space)
    named = space.save(named, "named")
    counts = _link_counts(named, sets.select("pid", "shingles"), _Measure(threshold), space)
    space.drop(sets)
    named = named.join(counts, "pid", "left").select("k1", "k2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    some = measured.filter("n > 0").select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    none = measured.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.union(none)


def one_of_each(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """Keeps one row of each group, that with the smallest doc_id (null comes last; of
    equal ids the one whose text has the lowest hash), and every document that
    links with nothing; of rows that are equal in doc_id and text one stays.
    Columns stay as they are."""
    space = Workspace(docs.sparkSession, "similar")
    measured, named, _ = _components(docs, words, threshold, space)
    some = measured.filter("n > 0").select(*_KEYS, "k1", "k2").join(named.select("k1", "k2", "component"), ["k1", "k2"])
    first = some.groupBy("component").agg(F.min(F.struct(*_KEYS)).alias("k")).select("k.*")
    kept = space.save(first.union(measured.filter("n = 0").select(*_KEYS).distinct()), "kept")
    # equal rows become one before texts are moved, and they are moved once
    rows = docs.select(*_row_keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).dropDuplicates(_KEYS)
    return rows.join(kept.hint("merge"), _KEYS, "left_semi").select("__row.*")


def _bit(c: Column | str) -> Column:
    """A value's place in a bit map."""
    return F.pmod(F.xxhash64(c), F.lit(MAP_BITS)).alias("bit")


def _bit_map(places: DataFrame) -> bytes:
    """The map with the bits set that ``places`` (one column, bit) names."""
    one = F.col("bit") + 1  # Spark's buckets and bits count from one
    marked = places.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for bucket, bits in marked.collect():  # MAP_BITS / 8 bytes at most
        at = (bucket - 1) * 4096
        whole[at : at + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return whole.tobytes()


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sets_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some points, and of a few whose bit in a map is the same: no set is
    shuffled for that."""
    wanted = sets.sparkSession.sparkContext.broadcast(_bit_map(members.select(_bit("pid"))))

    @worker
    def run(batches: Batches) -> Batches:
        bits = np.frombuffer(wanted.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(_is_set(bits, b.column(0).to_numpy()))).select([1, 2])

    return sets.select(_bit("pid"), "pid", "shingles").mapInArrow(run, "pid long, shingles binary")


def _whole_windows(sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """``(pid, n, window)``: as many shingles of the whole set as a partner cannot lack all
    of, the common ones last.  All sets' shingles are in one order, so the windows of
    two that link have a shingle in common."""

    @worker
    def shingles(batches: Batches) -> Batches:
        for b in batches:
            for s in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_buffer(), np.int64))], names=["h"])

    sample = sets.filter(F.pmod(F.xxhash64("pid"), F.lit(COMMON_SAMPLE)) == 0).select("shingles").mapInArrow(shingles, "h long")
    common = sample.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= max(2, REGION_POINTS // (2 * COMMON_SAMPLE)))
    often = sets.sparkSession.sparkContext.broadcast(_bit_map(common.select(F.pmod("h", F.lit(MAP_BITS)).alias("bit"))))
    num, den = measure.num, measure.den

    @worker
    def windows(batches: Batches) -> Batches:
        bits = np.frombuffer(often.value, np.uint8)
        for b in batches:
            n, window = [], []
            for s in b.column(1):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                last = _is_set(bits, (s & np.uint64(MAP_BITS - 1)).astype(np.int64))
                n.append(len(s))
                window.append(np.concatenate([s[~last], s[last]])[: len(s) - -(-len(s) * num // den) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(window, pa.list_(pa.int64()))], names=["pid", "n", "window"])

    return space.save(sets.mapInArrow(windows, "pid long, n long, window array<long>"), "windows")


def _needed_sets(docs: DataFrame, needed: DataFrame, words: int, space: Workspace) -> DataFrame:
    """``(pid, shingles, regions)`` of the points that some region holds; ``needed`` has their
    pid, k1, k2, smallest doc_id and regions.  A bit map of fixed size over these ids lets
    most other texts go before anything is shuffled; the join that follows is exact."""
    needed = space.save(needed, "needed")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(needed.select(_bit("low_id"))))

    @worker
    def run(batches: Batches) -> Batches:
        bits, seen = np.frombuffer(sent.value, np.uint8), Recent()
        for b in text_steps(batches, 1):
            b = b.filter(pa.array(_is_set(bits, b.column(0).to_numpy())))
            found = []
            for s in shingle_sets(b.column(1), words) if b.num_rows else ():
                if len(s) and seen.new(name := digest(s)):  # a copy's set is not sent again
                    found.append((*name, s.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "shingles"])

    rows = docs.select(_bit(F.col("doc_id").cast("long")), F.col("text").cast("string")).mapInArrow(run, "k1 long, k2 long, shingles binary")
    # neither side is small, whatever an estimate says; copies are dropped where the join has put them
    found = rows.join(needed.select("pid", "k1", "k2", "regions").hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return space.save(found.select("pid", "shingles", "regions"), "sets")


def _small_regions(members: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    return _joined(members.select("region", "pivot", "pid").join(sets, "pid"), measure, space)


def _joined(rows: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """Links inside regions that one task takes: ``(region, pivot, pid, shingles)``, the
    pivot among them."""

    def join(t: pa.Table) -> pa.Table:
        pid, p = _points(t)
        forest = _Forest(len(pid))
        join_region(p, np.arange(len(pid)), int(np.flatnonzero(pid == t["pivot"][0].as_py())[0]), measure, forest)
        return _links(pid, forest)

    return space.save(rows.groupBy("region").applyInArrow(join, LINKS), "links")


#: Rounds in which a large region is split between two pivots at most.
ROUNDS = 8
REGION = "region string, pivot long, pid long, n long, common long, size long"


def _star(members: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """``(region, pivot, pid, n, chunks)`` to each point's common shingles with its
    pivot, and the pivot's size; chunk by chunk."""
    rows = members.select("region", "pivot", "pid", "n", F.pmod(F.xxhash64("pid"), "chunks").cast("int").alias("chunk"), F.lit(False).alias("lead"))
    leads = members.select("region", "pivot", "chunks").distinct().select("region", "pivot", F.col("pivot").alias("pid"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("lead"))

    def compare(t: pa.Table) -> pa.Table:
        lead = t["lead"].to_numpy()
        if lead.all():
            t = t.slice(0, 0)
            return t.select(["region", "pivot", "pid", "n"]).append_column("common", pa.array([], pa.int64())).append_column("size", pa.array([], pa.int64()))
        pid, p = _points(t)
        at, own = int(np.flatnonzero(lead)[0]), np.flatnonzero(~lead)
        # the pivot may be a member as well: what it has in common with itself is its size
        common = np.where(pid[own] == pid[at], p.n[at], p.with_one(at, own))
        own_rows = t.select(["region", "pivot", "pid", "n"]).take(pa.array(own))
        return own_rows.append_column("common", pa.array(common, pa.int64())).append_column("size", pa.array(np.full(len(own), p.n[at]), pa.int64()))

    return space.save(rows.unionByName(leads).join(sets, "pid").groupBy("region", "chunk").applyInArrow(compare, REGION), "star")


def _apart() -> Column:
    """Distance of a star's point from its pivot."""
    return 1 - F.col("common") / (F.col("n") + F.col("size") - F.col("common"))


def _centred(large: DataFrame, star: DataFrame, space: Workspace) -> DataFrame:
    """The members with another pivot, the point nearest to the one before: of near copies
    of one text that is the text itself, if it is there."""
    nearest = star.filter("pid <> pivot").groupBy("region").agg(F.min_by("pid", F.struct(_apart(), "pid")).alias("pivot"))
    return large.drop("pivot").join(space.save(nearest, "centres"), "region")


def _large_regions(large: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> list[DataFrame]:
    """Links inside regions of several chunks, ``(region, pivot, pid, n, chunks)``."""
    linked = F.col("common") * measure.den >= (F.col("n") + F.col("size") - F.col("common")) * measure.num
    apart = _apart()
    reach = 2 * (1 - measure.num / measure.den) + 1e-9
    first = _star(large, sets, space)
    found = [first.filter(linked & (F.col("pid") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("pid").alias("b"))]
    large = _centred(large, first, space)
    for k in range(ROUNDS):
        star = _star(large, sets, space).withColumn("near", linked).withColumn("far_by", apart)
        found.append(star.filter("near and pid <> pivot").select(F.col("pivot").alias("a"), F.col("pid").alias("b")))
        # few points outside the ball meet all chunks, which is linear; many ask for another pivot
        outside = star.groupBy("region").agg(F.count_if(~F.col("near")).alias("out"), F.sum(F.when(~F.col("near"), F.col("n")).otherwise(0)).alias("weight"), F.max_by(F.when(~F.col("near"), F.col("pid")), F.when(~F.col("near"), F.struct("far_by", "pid"))).alias("second"))
        outside = space.save(outside.filter("out > 0").withColumn("few", (F.col("out") <= REGION_POINTS) & (F.col("weight") <= REGION_SHINGLES)), "outside")
        rest = space.save(star.join(outside, "region"), "rest")
        few = rest.filter("few")
        found.append(_few_against_all(few, sets, measure, space))
        many = rest.filter("not few")
        if not many.take(1):
            return found
        again = _star(_sized(many.select("region", F.col("second").alias("pivot"), "pid", "n"), "region"), sets, space)
        both = many.select("region", "pivot", "pid", "n", "near", "second", "far_by").join(again.select("region", "pid", apart.alias("far_by_second")), ["region", "pid"])
        left, right = F.col("far_by") <= F.col("far_by_second") + reach, F.col("far_by_second") <= F.col("far_by") + reach
        both = space.save(both.withColumn("left", left & (F.col("pid") != F.col("pivot"))).withColumn("right", right), "both")
        counts = both.groupBy("region").agg(F.count(F.lit(1)).alias("all"), F.count_if("left").alias("l"), F.count_if("right").alias("r"), F.min(F.when(F.col("left"), F.struct("near", "pid"))).alias("next"))
        counts = space.save(counts.withColumn("split", (F.greatest("l", "r") <= 0.9 * F.col("all")) & F.lit(k + 1 < ROUNDS)).select("region", "split", F.col("next.pid").alias("next")), "counts")
        parted = both.join(counts, "region")
        whole = parted.filter("not split").select("region", "pid", "n", (~F.col("near") & (F.col("pid") != F.col("pivot"))).alias("out"))
        found.append(_block_pairs(whole, sets, measure, space))
        halves = [parted.filter(f"split and {side}").select(F.concat("region", F.lit(name)).alias("region"), F.col(pivot).alias("pivot"), "pid", "n") for side, name, pivot in (("left", "l", "next"), ("right", "r", "second"))]
        parts = space.save(_sized(halves[0].union(halves[1]), "region"), "halves")
        found.append(_small_regions(parts.filter("chunks = 1"), sets, measure, space))
        large = parts.filter("chunks > 1")
        if not large.take(1):
            return found
    return found


def _met(t: pa.Table, measure: _Measure) -> pa.Table:
    """Links between the points marked ``out`` and the others of a table."""
    out = t["out"].to_numpy()
    pid, p = _points(t)
    forest = _Forest(len(pid))
    if out.any() and not out.all():
        _block(p, np.flatnonzero(out), np.flatnonzero(~out), measure, forest)
    return _links(pid, forest)


def _few_against_all(rest: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """Regions' few points outside their pivots' balls against every chunk."""
    rows = _sized(rest.select("region", "pivot", "pid", "n", "near"), "region")
    every = rows.select("region", "pid", F.pmod(F.xxhash64("pid"), "chunks").cast("int").alias("chunk"), F.lit(False).alias("out"))
    few = rows.filter("not near").select("region", "pid", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("out"))
    return space.save(every.union(few).join(sets, "pid").groupBy("region", "chunk").applyInArrow(lambda t: _met(t, measure), LINKS), "few")


def _block_pairs(rows: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """``(region, pid, n, out)``: the points outside against all, block by block.
    Points are dealt by size, in steps of the threshold: only neighbouring steps
    can link."""
    step = float(-np.log(measure.num / measure.den)) if measure.num < measure.den else 1.0
    rows = rows.withColumn("b", F.floor(F.log("n") / step).cast("int"))
    blocks = lambda which: F.ceil(F.greatest(F.count_if(which) / REGION_POINTS, F.sum(F.when(which, F.col("n"))) / REGION_SHINGLES)).cast("int")
    counts = space.save(rows.groupBy("region", "b").agg(F.coalesce(blocks(F.col("out")), F.lit(0)).alias("outs"), blocks(F.lit(True)).alias("alls")), "blocks")
    near = F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))

    def dealt(which: Column, own: str, other: str, out: bool) -> DataFrame:
        mine = rows.filter(which).join(counts.select("region", "b", own), ["region", "b"]).withColumn("to", near)
        with_other = mine.join(counts.select("region", F.col("b").alias("to"), other).filter(F.col(other) > 0), ["region", "to"])
        block = F.pmod(F.xxhash64("pid", F.lit(int(out))), own).cast("int")
        return with_other.select("region", F.col("b" if out else "to").alias("b1"), F.col("to" if out else "b").alias("b2"), block.alias("x"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("y"), "pid", F.lit(out).alias("out"))

    outside = dealt(F.col("out"), "outs", "alls", True).withColumnsRenamed({"x": "i", "y": "j"})
    every = dealt(F.lit(True), "alls", "outs", False).withColumnsRenamed({"x": "j", "y": "i"})
    return space.save(outside.unionByName(every).join(sets, "pid").groupBy("region", "b1", "b2", "i", "j").applyInArrow(lambda t: _met(t, measure), LINKS), "pairs")


# --- how many links ------------------------------------------------------------

COUNTS = "pid long, links long"
#: Most points of a group, or block of one, that a task counts: more than in a region,
#: since a block's sets are sent to every block that they may link with.
COUNT_POINTS = 2048
#: Bands of distance from the centre for each threshold's worth: more of them prune
#: little more, and every band is sent to each that it may link with.
BANDS = 2


def _tally(p: _Points, rows: np.ndarray, cols: np.ndarray, copies: np.ndarray, measure: _Measure) -> tuple[np.ndarray, np.ndarray]:
    """How many copies each row point's, and each column point's, links lead to; found
    in strips."""
    left, right = np.zeros(len(rows), np.int64), np.zeros(len(cols), np.int64)
    for lo in range(0, len(rows), 512):
        r = rows[lo : lo + 512]
        for lc in range(0, len(cols), 512):
            c = cols[lc : lc + 512]
            met = measure.linked(p.products(r, c), p.n[r][:, None], p.n[c][None, :]) & (r[:, None] != c[None, :])
            left[lo : lo + 512] += met @ copies[c]
            right[lc : lc + 512] += copies[r] @ met
    return left, right


def _link_counts(named: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """``(pid, links)`` of every grouped point: the rows of other sets that it links to.
    Links never leave a component."""
    members = named.filter("grouped").select(F.col("component").cast("string").alias("region"), F.col("component").alias("pivot"), "pid", "n", "copies")
    members = space.save(_sized(members, "region", COUNT_POINTS), "grouped")

    def count(t: pa.Table) -> pa.Table:
        pid, p = _points(t)
        every = np.arange(len(pid))
        return pa.table({"pid": pid, "links": _tally(p, every, every, t["copies"].to_numpy(), measure)[0]})

    small = members.filter("chunks = 1").select("region", "pid", "copies").join(sets, "pid").groupBy("region").applyInArrow(count, COUNTS)
    counts = space.save(small, "counts")
    large = members.filter("chunks > 1")
    if large.take(1):
        counts = counts.union(_large_counts(large, sets, measure, space)).groupBy("pid").agg(F.sum("links").alias("links"))
    return counts


def _large_counts(large: DataFrame, sets: DataFrame, measure: _Measure, space: Workspace) -> DataFrame:
    """``(pid, links)`` in parts, for components of several chunks.

    A first star finds a centre, whose own star deals the points out to bands of distance.
    Two bands whose far edges add up to no more than the threshold are linked throughout;
    two whose near edges are further apart than it are not linked at all."""
    step = (1 - measure.num / measure.den) / BANDS
    if step <= 0:  # only equal sets link, and they are one point
        return large.select("pid", F.lit(0).cast("long").alias("links"))
    star = _star(_centred(large, _star(large, sets, space), space), sets, space)
    banded = star.select("region", "pid", "n", F.floor(_apart() / step).cast("int").alias("band")).join(large.select("pid", "copies"), "pid")
    banded = space.save(banded, "banded")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / COUNT_POINTS, F.sum("n") / REGION_SHINGLES)).cast("int")
    bands = space.save(banded.groupBy("region", "band").agg(F.sum("copies").alias("weight"), blocks.alias("blocks")), "bands")
    sure = lambda a, b: F.col(a) + F.col(b) + 2 <= BANDS
    others = bands.select("region", F.col("band").alias("other"), F.col("weight").alias("other_weight"), F.col("blocks").alias("other_blocks"))
    pairs = space.save(bands.join(others, "region").filter(F.abs(F.col("band") - F.col("other")) <= BANDS + 1), "bands")

    whole = pairs.filter(sure("band", "other")).groupBy("region", "band").agg(F.sum("other_weight").alias("weight"))
    own = F.when(sure("band", "band"), F.col("copies")).otherwise(0)
    certain = banded.join(whole, ["region", "band"]).select("pid", (F.col("weight") - own).alias("links"))

    rows = banded.join(pairs.filter(~sure("band", "other")).select("region", "band", "blocks", "other", "other_blocks"), ["region", "band"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("pid"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    mine, its = F.struct(F.col("band").alias("band"), F.col("own").alias("block")), F.struct(F.col("other").alias("band"), F.col("met").alias("block"))
    rows = rows.select("region", F.least(mine, its).alias("one"), F.greatest(mine, its).alias("two"), (mine <= its).alias("left"), (mine == its).alias("alone"), "pid", "copies")

    def compare(t: pa.Table) -> pa.Table:
        pid, p = _points(t)
        copies, left, alone = t["copies"].to_numpy(), t["left"].to_numpy(), t["alone"][0].as_py()
        a, b = np.flatnonzero(left), np.flatnonzero(left if alone else ~left)
        to_a, to_b = _tally(p, a, b, copies, measure)
        if alone:
            return pa.table({"pid": pid[a], "links": to_a})
        return pa.table({"pid": np.concatenate([pid[a], pid[b]]), "links": np.concatenate([to_a, to_b])})

    keys = [F.col("one.band").alias("b1"), F.col("one.block").alias("x"), F.col("two.band").alias("b2"), F.col("two.block").alias("y")]
    rows = rows.select("region", *keys, "left", "alone", "pid", "copies").join(sets, "pid")
    return certain.union(space.save(rows.groupBy("region", "b1", "x", "b2", "y").applyInArrow(compare, COUNTS), "counted"))
