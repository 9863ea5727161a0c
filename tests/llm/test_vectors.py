import numpy as np
import pytest

from strandline.llm import vectors
from strandline.llm.components import connected_components
from strandline.llm.workspace import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, n string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "d", "n", "c") for i, v, lab in rows], SCHEMA)


def clustered(n=260, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = rng.normal(size=dim) if i % 3 == 0 else centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


def plain(rows, cosine=0.98):
    ok = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (links[i], find(i), find(i) == i) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("block,replica", [(2048, 400.0), (16, 0.001)])
def test_against_all_pairs(spark, monkeypatch, block, replica):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "REPLICA_COST", replica)  # nearly free replicas: many cells
    rows = clustered()
    rows += [(1000 + k, rows[4][1], rows[4][2]) for k in range(30)]  # copies
    want = plain(rows)
    assert result(vectors.near_duplicates(table(spark, rows).repartition(3))) == want
    assert sum(n for n, _, _ in want.values()) > 1000


def test_cells_hold_all_partners():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 6))
    u[200:] = u[:200] + rng.normal(size=(200, 6)) * 0.08
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = vectors.fit_centroids(u, 32)
    row, cell, own = vectors._cells(u, c, float(np.sqrt(1 - 0.98**2)))
    home = dict(zip(row[own].tolist(), cell[own].tolist()))
    at = set(zip(row.tolist(), cell.tolist()))
    pairs = [(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98)) if i < j]
    assert len(c) > 20 and pairs
    for i, j in pairs:
        assert home[i] == home[j] or ((i, home[j]) in at) != ((j, home[i]) in at)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [float("nan"), 2.0, 3.0], 0), (9, [float("inf"), 2.0, 3.0], 0), (10, [], 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [-0.0, 1.0, 0.0], 0), (14, [0.0, 1.0, 0.0], 0)]
    assert result(vectors.near_duplicates(table(spark, rows))) == plain(rows)
    null_id = vectors.near_duplicates(table(spark, [(None, v, 0), (5, v, 0)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in null_id) == [(0, 1, 5, False), (5, 1, 5, True)]
    twice = vectors.near_duplicates(table(spark, [(5, v, 0), (5, v, 0)])).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in twice] == [(1, 5, True)] * 2
    assert vectors.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (4, 3), (3, 30), (20, 21), (21, 20), (40, 40), (50, 51), (52, 51), (53, 52), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got == {**{i: 3 for i in (3, 4, 5, 6, 7, 8, 9, 30)}, 20: 20, 21: 20, **{i: 50 for i in (50, 51, 52, 53)}}
    assert connected_components(df.limit(0), Workspace(spark, "t")).count() == 0
