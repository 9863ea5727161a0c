"""Value levels against plain scans: many values, ties, wide ranges, a kept table."""

import random
from collections import Counter

import pytest

from strandline.operators import sequence
from strandline.plans.value_levels import WORD, ValueIndex


def expected(v, k, value, low, high):
    s = sorted(v)
    less = [x for x in s if x < value]
    return s[k] if 0 <= k < len(s) else None, sum(low <= x < high for x in v), less[-1] if less else None


def test_values(spark, tmp_path, kind="string"):
    rng = random.Random(5)
    own = int if kind == "int" else (lambda x: f"v{x:06d}")
    seqs = {1: [own(rng.randrange(1_000_000)) for _ in range(700)], 2: [own(7)], 3: [own(rng.randrange(3)) for _ in range(2 * WORD)], 4: [own(5)] * WORD}
    s = spark.createDataFrame([(k, i, v) for k, vs in seqs.items() for i, v in enumerate(vs)], f"seq_id int, pos long, val {kind}")
    rows = []
    for k, vs in seqs.items():
        for i in range(12):
            a, b = sorted(rng.sample(range(len(vs) + 1), 2)) if i else (0, len(vs))
            low, high = sorted(rng.choices(vs + [own(0), own(999_999_999)], k=2))
            rows.append((k * 100 + i, k, a, b, rng.randrange(-1, b - a + 1), rng.choice(vs + [own(500_000), own(0)]), low, high))
    q = spark.createDataFrame(rows, f"qid int, seq_id int, start long, end long, k int, value {kind}, min_value {kind}, max_value {kind}")
    ValueIndex.build(s).save(f"file://{tmp_path}/values")
    index = ValueIndex.load(spark, f"file://{tmp_path}/values")
    want = {r[0]: expected(seqs[r[1]][r[2] : r[3]], *r[4:]) for r in rows}
    assert {r[0]: r[1] for r in index.quantile(q).collect()} == {i: w[0] for i, w in want.items()}
    assert {r[0]: r[1] for r in index.range_freq(q).collect()} == {i: w[1] for i, w in want.items()}
    assert {r[0]: tuple(r)[1:] for r in index.smaller_value(q).collect()} == {i: (w[2], w[2] is not None) for i, w in want.items()}
    assert {tuple(r) for r in index.quantile(q).collect()} == {tuple(r) for r in sequence.quantile(s, q).collect()}


def test_rows_of_a_query_are_bounded_by_the_depth(spark):
    """As many distinct values as elements: two rows a level."""
    n = 1 << 16
    s = spark.range(n).selectExpr("1 as seq_id", "id as pos", "(id * 40503) % 65537 as val")
    index = ValueIndex.build(s)
    assert index.depth == 16 and index.words.count() == 16 * (n // WORD + 1)
    q = spark.createDataFrame([(1, 1, 0, n, n // 2), (2, 1, 5, n - 7, 17)], "qid int, seq_id int, start long, end long, k long")
    values = [i * 40503 % 65537 for i in range(n)]
    assert {r[0]: r[1] for r in index.quantile(q).collect()} == {1: sorted(values)[n // 2], 2: sorted(values[5 : n - 7])[17]}


def most_frequent(v, k):
    ranked = sorted(Counter(v).items(), key=lambda x: (x[1], x[0]), reverse=True)
    return [(value, n, i) for i, (value, n) in enumerate(ranked[: max(k or 0, 0)], 1)]


def test_frequent_and_larger_values(spark):
    rng = random.Random(6)
    seqs = {1: [rng.randrange(30) ** 2 for _ in range(300)], 2: [7], 3: [rng.randrange(3) for _ in range(2 * WORD)], 4: list(range(40)), 5: [rng.choice([9, 9, rng.randrange(500)]) for _ in range(400)]}
    s = spark.createDataFrame([(k, i, v) for k, vs in seqs.items() for i, v in enumerate(vs)], "seq_id int, pos long, val int")
    rows = []
    for k, vs in seqs.items():
        for i in range(10):
            a, b = sorted(rng.choices(range(len(vs) + 1), k=2)) if i else (0, len(vs))
            rows.append((k * 100 + i, k, a, b, rng.choice([-1, 0, 1, 2, 5, 1000, None]), rng.choice([*vs, -1, 4, 10**6, None])))
    q = spark.createDataFrame(rows, "qid int, seq_id int, start long, end long, k int, value int")
    index = ValueIndex.build(s)
    parts = {r[0]: (seqs[r[1]][r[2] : r[3]], r[4], r[5]) for r in rows}
    assert Counter(tuple(r) for r in index.top_k(q, strict=False).collect()) == Counter((i, *m) for i, (v, k, _) in parts.items() for m in most_frequent(v, k))
    assert {tuple(r) for r in index.range_mode(q, strict=False).collect()} == {(i, *most_frequent(v, 1)[0][:2]) for i, (v, _, _) in parts.items() if v}
    above = {i: min([x for x in v if value is not None and x > value], default=None) for i, (v, _, value) in parts.items()}
    assert {tuple(r) for r in index.larger_value(q, strict=False).collect()} == {(i, x, x is not None) for i, x in above.items()}
    assert {tuple(r) for r in index.top_k(q, strict=False).collect()} == {tuple(r) for r in sequence.top_k(s, q, strict=False).collect()}
    assert index.top_k(q.limit(0)).count() == 0 and index.range_mode(q.limit(0)).count() == 0


def test_a_frequent_value_leaves_few_halves(spark, monkeypatch):
    """A third of a range is one value, the others all differ: few rows are opened."""
    n = 1 << 12
    s = spark.range(n).selectExpr("1 as seq_id", "id as pos", "case when id % 3 = 0 then 20000 else 3 * id end as val")
    index = ValueIndex.build(s)
    opened, plain = [], ValueIndex._halves

    def counted(self, rows, level):
        out = plain(self, rows, level)
        opened.append(out.count())
        return out

    monkeypatch.setattr(ValueIndex, "_halves", counted)
    q = spark.createDataFrame([(1, 1, 0, n)], "qid int, seq_id int, start long, end long")
    assert [tuple(r) for r in index.range_mode(q).collect()] == [(1, 20000, n // 3 + 1)]
    assert sum(opened) < 8 * index.depth


def test_row_numbers_move_rows_once(spark):
    from pyspark.sql import functions as F

    from strandline.plans.ranking import global_positions

    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"), "id")
    found = global_positions(rows, ["v"], "n", start=3)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["v"], r["n"]) for r in found.collect())
    assert found.columns == ["v", "id", "n"] and [n for _, n in got] == list(range(3, 5003))


@pytest.mark.parametrize("name", ["quantile", "range_freq", "smaller_value", "larger_value", "top_k", "range_mode"])
def test_nothing_that_grows_goes_through_the_driver(spark, monkeypatch, name):
    """Only the partitions' offsets are sent whole, however small the tables' files are."""
    from strandline.plans import value_levels

    s = spark.range(400).selectExpr("id % 2 as seq_id", "id div 2 as pos", "id * 7 % 5 as val")
    plans, plain = [], value_levels.write_table
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(value_levels, "write_table", lambda df, *a, **b: plans.append(plan(df)) or plain(df, *a, **b))
    q = spark.range(4).selectExpr("id as qid", "id % 2 as seq_id", "5 as start", "150 + id as end", "2 as k", "3L as value", "1L as min_value", "4L as max_value")
    plans.append(plan(getattr(ValueIndex.build(s), name)(q)))
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    assert [line for line in joins if "[__part#" not in line] == []
