import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import documents, empty
from pyspark.sql import functions as F

from strandline.llm import mixing


def targets(sizes: dict, cap: int = 3) -> dict:
    """Resharing one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        out |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return out


def check(spark, docs):
    rows = docs.collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r)
    want = targets(sizes)
    got = mixing.curriculum(docs, columns=["doc_id", "source"]).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((r["doc_id"], size(r), sizes[r["source"]]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    return got


def test_against_resharing(spark):
    got = check(spark, documents(spark).repartition(4))
    order = [r["position"] for r in mixing.curriculum(documents(spark)).select("position").collect() if r["position"] is not None]
    assert order == sorted(order) and len(got) == documents(spark).count()


def test_blocks_and_reruns(spark, monkeypatch):
    one = sorted(map(tuple, mixing.curriculum(documents(spark)).collect()), key=str)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    many = sorted(map(tuple, mixing.curriculum(documents(spark).repartition(7)).collect()), key=str)
    assert one == many


def test_caps_are_reshared_until_none_is_above(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 500), ("b", 3), ("c", 2), ("d", 40), ("e", 0), (None, 7), ("Z", 90)])]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_only_empty_texts(spark):
    got = mixing.curriculum(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.curriculum(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 2.0)], [(0.0, 3.0), (0.4, 0.0), (0.7, 0.0), (1.0, 1.0)]])
def test_due_time_inverts_the_integral(spark, knots):
    array = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots])
    got = spark.range(0, 101).select((F.col("id") / 100).alias("f"), mixing.due_time(F.col("id") / 100, array).alias("t")).collect()
    whole = mixing.integral(knots, 1.0)
    assert all(abs(mixing.integral(knots, r["t"]) / whole - r["f"]) < 1e-9 for r in got)
    assert np.all(np.diff([r["t"] for r in got]) >= 0)


def test_schedule_moves_sources_in_time(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("a", [(0.0, 2.0), (1.0, 0.0)]), ("b", [(0.0, 0.0), (1.0, 2.0)])], "source string, knots array<struct<t double, w double>>")
    got = mixing.curriculum(docs, schedule, columns=["doc_id", "source"]).collect()
    for name, size in (("time", 1.0), ("position", 4000.0)):
        mean = {s: np.mean([r[name] for r in got if r["source"] == s]) for s in "ab"}
        assert abs(mean["a"] - size / 3) < 0.02 * size and abs(mean["b"] - size * 2 / 3) < 0.02 * size
    assert {r["taken"] for r in got} == {10}


def test_default_schedules():
    assert [mixing.integral(k, 1.0) for k in mixing.CYCLE] == [1.0, 2.0, 3.0]
    for w in range(3):  # they differ in time
        assert len({round(mixing.integral(k, 0.5) / mixing.integral(k, 1.0), 3) for k in mixing.CYCLE}) == 3


def test_positions_invert_the_demand(spark):
    """Times and positions, step by step: each source in turn, by bisection."""
    docs = documents(spark).filter("doc_id <> 300 or doc_id is null")
    got = mixing.curriculum(docs, columns=["doc_id", "source"]).collect()
    names = sorted({r["source"] for r in got}, key=lambda s: (s is None, (s or "").encode()))
    knots = {s: mixing.CYCLE[i % 3] for i, s in enumerate(names)}
    goal = {r["source"]: round(r["target"]) for r in got}
    asked = lambda s, t: goal[s] * mixing.integral(knots[s], t) / mixing.integral(knots[s], 1.0)
    for s in names:
        rows = sorted((r for r in got if r["source"] == s and r["position"] is not None), key=lambda r: r["time"])
        before = 0
        for r in rows:
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if asked(s, mid) < before else (low, mid)
            assert abs(r["time"] - high) < 1e-6
            assert abs(r["position"] - sum(asked(x, r["time"]) for x in names)) < 1e-6 * sum(goal.values())
            before += r["size"]
        assert all(r["position"] is None for r in got if r["source"] == s and not r["size"])
    assert len({round(r["position"], 3) for r in got if r["position"] is not None}) > 30


def test_copies_in_chunks(spark, monkeypatch):
    """Rows that are equal, some without an id: dealt out in chunks, as one by one."""
    rows = [(None, "a b c", "x")] * 50 + [(7, "d e", "x")] * 30 + [(7, "f", "x")] + [(None, None, None)] * 9 + [(i, "g h", "y") for i in range(8, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = check(spark, docs)
    assert len(got) == len(rows)
    one = Counter(map(tuple, mixing.curriculum(docs).collect()))
    monkeypatch.setattr(mixing, "COPIES", 4)
    assert Counter(map(tuple, mixing.curriculum(docs.repartition(3)).collect())) == one
    mixed = mixing.mixed_documents(docs).collect()
    taken = sum(r["taken"] for r in got)
    assert abs(sum(len((r["text"] or "").split()) for r in mixed) - taken) < 0.2 * taken


def test_mixed_documents(spark):
    docs = documents(spark).filter("doc_id <> 300 or doc_id is null")
    plan = {r["doc_id"]: r for r in mixing.curriculum(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    count = Counter(r["doc_id"] for r in got.collect())
    for d, r in plan.items():
        assert count[d] == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 1)


def test_lots_follow_no_order_of_rows(spark, monkeypatch):
    """Copies, wholly equal or not, are the same ones however rows are dealt out."""
    rows = [(i % 3, "a b c d", "x", i // 4) for i in range(60)] + [(i, f"e{i} f g", "y", 0) for i in range(40)] + [(None, "h", None, 0)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = []
        for n, keys in ((3, 1 << 17), (8, 1 << 17), (17, 0), (211, 1 << 17)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            monkeypatch.setattr(mixing, "LOT_KEYS", keys)
            got.append(Counter(map(tuple, mixing.mixed_documents(docs.repartition(n)).collect())))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got[0] == got[1] == got[2] == got[3] and set(got[0]) <= set(rows) and got[0].total() > 60
