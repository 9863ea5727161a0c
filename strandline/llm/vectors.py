"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Equal vectors are collapsed first.  Centroids are fitted on a bounded sample;
every vector goes to its nearest centroid's cell and, as a replica, to each
cell of a lower number whose bisecting hyperplane it stands near enough to have
a partner beyond (an angle below the threshold's).  So any two partners meet in
exactly one of their cells and no link is lost.  The number of cells is the one
with the least estimated cost of products and replicas at the table's size.  Cells are cut into blocks, and pairs of blocks
are multiplied; a block pair emits one count a vector and a spanning forest of
its links, never the pairs.

Defined cases: rows whose label is null, or whose vector is null, empty, zero
or holds null or non-finite components, link with nothing; vectors of different
lengths never link; repeated rows are vectors of their own; a null id never
becomes a component's name unless all its members' ids are null; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.workspace import Batches, Recent, Workspace, worker

#: Bound of the sample that centroids are fitted on.
SAMPLE_ROWS = 16384
#: Most vectors on either side of a block product.
BLOCK_ROWS = 2048
MAX_CELLS = 2048
#: What moving a replica costs, in products of two vectors.
REPLICA_COST = 400.0


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None where they cannot be compared."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid:
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


@worker
def _digested(batches: Batches) -> Batches:
    """Adds each usable vector's digest and, once a task for each, its bytes."""
    seen = Recent()
    for b in batches:
        labels = b.column(1).to_pylist()
        digests, raws = [], []
        for v, label in zip(_matrix(b.column(2)), labels):
            raw = _pack(v) if v is not None and label is not None else None
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            raws.append(raw if raw is not None and seen.new((label, digests[-1])) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "digest", "raw"])


def _pack(v: np.ndarray) -> bytes:
    """A vector's bytes: single precision where that loses nothing."""
    v = v + 0.0  # -0.0 is 0.0
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"\4" + single.tobytes() if (single == v).all() else b"\b" + v.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[0] == 4 else np.float64, offset=1).astype(np.float64)


def _dim(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def _unit(raw: list[bytes]) -> np.ndarray:
    m = np.array([_unpack(r) for r in raw])
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(unit: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(unit[k : k + 1024] @ c.T, axis=1) for k in range(0, len(unit), 1024)])


def fit_centroids(unit: np.ndarray, k: int, seed: int = 42, steps: int = 10) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = unit[rng.choice(len(unit), size=min(k, len(unit)), replace=False)]
    for _ in range(steps if k > 1 else 0):
        total = np.zeros_like(c)
        np.add.at(total, _nearest(unit, c), unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return np.unique(c, axis=0)


def _cells(unit: np.ndarray, c: np.ndarray, sine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's own, for own cells and replicas."""
    rows, cells, own = [], [], []
    for k in range(0, len(unit), 512):
        dots = unit[k : k + 512] @ c.T
        home = np.argmax(dots, axis=1)
        at = np.arange(len(dots))
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
        near = dots[at, home][:, None] - dots <= gap * sine + 1e-7
        near &= np.arange(len(c))[None, :] < home[:, None]
        near[at, home] = True
        row, cell = np.nonzero(near)
        rows.append(row + k)
        cells.append(cell)
        own.append(cell == home[row])
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)


def choose_centroids(raw: list[bytes], rows: int, labels: float, cosine: float) -> dict[int, np.ndarray]:
    """Centroids by vector length.  The number of cells is the one with the least
    estimated cost at the table's size; ``labels``: how many labels of equal
    share would give as many pairs."""
    out: dict[int, np.ndarray] = {}
    sine = np.sqrt(max(0.0, 1 - cosine * cosine))
    for dim in {_dim(r) for r in raw}:
        unit = _unit([r for r in raw if _dim(r) == dim])
        best, k = (float("inf"), unit[:1]), 1
        while k == 1 or k <= min(MAX_CELLS, len(unit) // 4):
            c = fit_centroids(unit, k)
            _, cell, own = _cells(unit, c, sine)
            n, every = np.bincount(cell[own], minlength=len(c)), np.bincount(cell, minlength=len(c))
            scale = rows / len(raw)
            cost = float((n * every).sum()) * scale**2 / labels + REPLICA_COST * len(cell) * scale
            if cost > 4 * best[0]:
                break
            if cost < best[0]:
                best = (cost, c)
            k *= 4
        out[dim] = best[1]
    return out


def _components(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the links of a block."""
    low = np.arange(n, dtype=np.int32)
    while True:
        new = low.copy()
        np.minimum.at(new, rows, np.where(near, low[cols][None, :], n).min(axis=1, initial=n))
        np.minimum.at(new, cols, np.where(near, low[rows][:, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``(vec_id, embedding, label)`` to vec_id, n_links, component_id, kept."""
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = space.save(rows.mapInArrow(_digested, "vec_id long, label string, digest binary, raw binary"), "digests")
    classes = rows.filter("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("raw", ignorenulls=True).alias("raw"))
    classes = space.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    share = min(1.0, 1.05 * SAMPLE_ROWS / max(1, total))
    lot = F.pmod(F.xxhash64("digest", "label"), F.lit(1 << 20))
    sample = [bytes(r[0]) for r in classes.filter(lot < int(share * (1 << 20)) + 1).select("raw").limit(SAMPLE_ROWS).collect()]
    pairs = classes.groupBy("label").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
    centroids = choose_centroids(sample, total, total * total / pairs if total else 1.0, cosine)
    sine = float(np.sqrt(max(0.0, 1 - cosine * cosine)))

    @worker
    def deal(batches: Batches) -> Batches:
        for b in batches:
            raw = b.column(3).to_pylist()
            dims = np.array([_dim(r) for r in raw])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 4096)):
                    unit = _unit([raw[i] for i in part])
                    row, cell, own = _cells(unit, centroids[dim], sine) if dim in centroids else (np.arange(len(part)), np.zeros(len(part), int), np.ones(len(part), bool))
                    take = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own)],
                        names=["cid", "label", "n", "raw", "dim", "cell", "own"],
                    )

    dealt = classes.select("cid", "label", "n", "raw").mapInArrow(deal, "cid long, label string, n long, raw binary, dim int, cell int, own boolean")
    dealt = space.save(dealt, "dealt")
    key = ["label", "dim", "cell"]
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")
    sizes = dealt.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("own").cast("int")) / BLOCK_ROWS)).cast("int").alias("na"), blocks.alias("nb"))
    sizes = space.save(sizes, "sizes")  # so that AQE can broadcast them or split a hot cell
    sized = dealt.join(sizes, key)
    mine = sized.filter("own").withColumn("a", F.pmod(F.xxhash64("cid"), "na").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))
    other = sized.withColumn("b", F.pmod(F.xxhash64("cid", F.lit(1)), "nb").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("side", F.lit(1))
    columns = [*key, "a", "b", "side", "own", "cid", "n", "raw"]
    met = mine.select(*columns).union(other.select(*columns))

    def multiply(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy() == 1
        cid, n, raw = t["cid"].to_numpy(), t["n"].to_numpy(), t["raw"].to_pylist()
        mine, other = np.flatnonzero(~side), np.flatnonzero(side)
        names, node = np.unique(cid, return_inverse=True)
        unit = _unit(raw)
        near = np.zeros((len(mine), len(other)), bool)
        for at in range(0, len(mine), 512):
            left = mine[at : at + 512]
            dots = unit[left] @ unit[other].T
            for i, j in zip(*np.nonzero(np.abs(dots - cosine) < 1e-9)):  # the plain formula decides at the edge
                x, y = _unpack(raw[left[i]]), _unpack(raw[other[j]])
                dots[i, j] = float(x @ y) / (float(np.linalg.norm(x)) * float(np.linalg.norm(y)))
            near[at : at + 512] = (dots >= cosine) & (cid[left][:, None] != cid[other][None, :])
        count = np.zeros(len(names), np.int64)
        np.add.at(count, node[mine], near @ n[other])
        # a replica meets its partners here only
        guest = np.flatnonzero(~t["own"].to_numpy()[other])
        np.add.at(count, node[other[guest]], n[mine] @ near[:, guest])
        low = _components(near, node[mine], node[other], len(names))
        hit, tied = np.flatnonzero(count), np.flatnonzero(low != np.arange(len(names)))
        return pa.table(
            {
                "cid": pa.array(np.concatenate([names[hit], names[tied]]), pa.int64()),
                "linked": pa.array(np.concatenate([count[hit], np.zeros(len(tied), np.int64)]), pa.int64()),
                "to": pa.array([None] * len(hit) + names[low[tied]].tolist(), pa.int64()),
            }
        )

    found = space.save(met.groupBy(*key, "a", "b").applyInArrow(multiply, "cid long, linked long, to long"), "found")
    links = found.filter("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b"))
    groups = connected_components(links, space)
    counts = found.filter("linked > 0").groupBy("cid").agg(F.sum("linked").alias("linked"))
    named = classes.select("cid", "label", "digest", "low", "n").join(counts, "cid", "left").join(groups.withColumnRenamed("id", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").select("label", "digest", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
