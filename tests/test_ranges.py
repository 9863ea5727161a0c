"""Range tables at powers of two against plain scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import ranges
from strandline.plans import dyadic

PLAIN = {"sum": sum, "count": len, "min": min, "max": max, "bit_xor": lambda v: __import__("functools").reduce(lambda a, b: a ^ b, v)}


def sequences(rng):
    return {1: [rng.randrange(50) for _ in range(333)], 2: [7], 3: [rng.randrange(3) for _ in range(64)], 4: [5] * 129}


def table(spark, seqs):
    return spark.createDataFrame([(k, i, v) for k, vs in seqs.items() for i, v in enumerate(vs)], "seq_id int, pos long, val int")


def asked(spark, seqs, rng, n=40):
    rows = []
    for k, vs in seqs.items():
        spans = {(0, len(vs))} | {tuple(sorted(rng.sample(range(len(vs) + 1), 2))) for _ in range(n if len(vs) > 1 else 0)}
        rows += [(k * 1000 + i, k, a, b) for i, (a, b) in enumerate(sorted(spans))]
    return rows, spark.createDataFrame(rows, "qid int, seq_id int, start long, end long")


@pytest.mark.parametrize("block", [5, 4096])
def test_every_aggregate(spark, block):
    rng = random.Random(block)
    seqs = sequences(rng)
    s, (rows, q) = table(spark, seqs), asked(spark, seqs, rng)
    for how, f in PLAIN.items():
        got = {r["qid"]: r["value"] for r in ranges.range_aggregate(s, q, how, block=block).collect()}
        assert got == {i: f(seqs[k][a:b]) for i, k, a, b in rows}, how
    text = s.withColumn("val", F.col("val").cast("string"))
    got = {r["qid"]: r["value"] for r in ranges.range_fold(text, q, lambda a, b: F.concat(a, F.lit(","), b), block=block).collect()}
    assert got == {i: ",".join(map(str, seqs[k][a:b])) for i, k, a, b in rows}
    for largest, pick in ((False, min), (True, max)):
        got = {r["qid"]: (r["value"], r["index"]) for r in ranges.range_best(s, q, largest, block=block).collect()}
        assert got == {i: (pick(seqs[k][a:b]), a + seqs[k][a:b].index(pick(seqs[k][a:b]))) for i, k, a, b in rows}


def test_rows_of_a_query_grow_with_the_logarithm(spark):
    spans = [(i, 1, a, b) for i, (a, b) in enumerate([(1, 10**9), (0, 10**9), (12_345, 98_765_432_100), (5, 6), (1, 64), (0, 64)])]
    q = spark.createDataFrame(spans, "qid int, seq_id int, start long, end long")
    found = dyadic.pieces(q, 1).collect()
    for i, _, a, b in spans:
        own = [(r["level"], r["node"]) for r in found if r["qid"] == i]
        assert len(own) <= 2 * (b - a).bit_length() and len(own) == len(set(own))
        covered = sorted((n << level, (n + 1) << level) for level, n in own)
        assert covered[0][0] == a and covered[-1][1] == b and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


@pytest.mark.parametrize("how", ["sum", "best_min"])
def test_kept_tables_grow(spark, tmp_path, how):
    """Built, saved, appended to twice, also with sequences that are new or become deeper."""
    rng = random.Random(3)
    seqs = sequences(rng)
    path = f"file://{tmp_path}/ranges"
    first = {1: seqs[1][:3], 3: seqs[3]}
    second = {1: seqs[1][3:70], 2: seqs[2], 4: seqs[4][:1]}
    third = {1: seqs[1][70:], 4: seqs[4][1:]}
    ranges.RangeIndex.build(table(spark, first), how, block=4).save(path)
    ranges.RangeIndex.append_to(spark, path, table(spark, second))
    ranges.RangeIndex.append_to(spark, path, table(spark, third))
    rows, q = asked(spark, seqs, rng)
    got = {r["qid"]: tuple(r)[1:] for r in ranges.RangeIndex.load(spark, path).query(q).collect()}
    if how.startswith("best_"):
        pick = min if how == "best_min" else max
        assert got == {i: (pick(seqs[k][a:b]), a + seqs[k][a:b].index(pick(seqs[k][a:b]))) for i, k, a, b in rows}
    else:
        assert got == {i: (PLAIN[how](seqs[k][a:b]),) for i, k, a, b in rows}
    bad = spark.createDataFrame([(1, 2, 0, 2)], "qid int, seq_id int, start long, end long")
    with pytest.raises(Exception, match="not inside"):
        ranges.RangeIndex.load(spark, path).query(bad).collect()


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "double"])
@pytest.mark.parametrize("largest", [False, True])
def test_best_of_all_values(spark, kind, largest):
    """Also nulls, which come first, and the ends of a type; whole numbers are hashed, not sorted."""
    rng = random.Random(9)
    end = {"tinyint": 7, "int": 31, "bigint": 63, "double": 40}[kind]
    values = [None, -(2 ** (end - 1)) * 2, 2**end - 1, 0, -1, 1]
    seqs = {k: [rng.choice(values) for _ in range(n)] for k, n in ((1, 90), (2, 1), (3, 12))}
    s = spark.createDataFrame([(k, i, v if v is None or kind != "double" else float(v)) for k, vs in seqs.items() for i, v in enumerate(vs)], f"seq_id int, pos long, val {kind}")
    rows, q = asked(spark, seqs, rng, 12)
    low = lambda v: (v is not None, v or 0)
    bys = {"none": (None, low), "two": (F.struct(F.col("val") % 2, F.col("val") > 0 if kind == "double" else (F.col("val") % 3).cast("tinyint")), None)}
    for block in (1, 7):
        for name, (by, key) in bys.items():
            found = ranges.range_best(s, q, largest, block=block, by=by)
            if kind == "int":
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert re.search(r"HashAggregate\(keys=\[qid#\d+, __block", plan) and re.search(r"HashAggregate\(keys=\[seq_id#\d+, __block", plan)
            got = {r["qid"]: (r["value"], r["index"]) for r in found.collect()}
            ordered = s.withColumn("o", F.col("val") if by is None else by).orderBy("seq_id", "pos").collect()
            for i, k, a, b in rows:
                part = [r for r in ordered if r["seq_id"] == k][a:b]
                rank = lambda r: low(r["o"]) if key else tuple(low(x) for x in r["o"])
                best = (max if largest else min)(part, key=rank)
                assert got[i] == (best["val"], best["pos"]), (name, block, i)


def test_appended_values_stay_where_they_are(spark, monkeypatch):
    """The lengths of few sequences are sent to the values; of many, they meet in a join."""
    rng = random.Random(5)
    seqs = sequences(rng)
    rows, q = asked(spark, seqs, rng, 6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (1_000_000, 0):
            monkeypatch.setattr(ranges, "FEW", few)
            index = ranges.RangeIndex.build(table(spark, {1: seqs[1][:50], 4: seqs[4][:1]}), "best_max", block=4)
            assert re.search(r"HashAggregate\(keys=\[seq_id#\d+, __block", index.nodes._jdf.queryExecution().executedPlan().toString())
            grown = index.append(table(spark, {1: seqs[1][50:], 2: seqs[2], 3: seqs[3], 4: seqs[4][1:]}))
            plan = grown.data._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (few > 0, few == 0)
            got = {r["qid"]: (r["value"], r["index"]) for r in grown.query(q).collect()}
            assert got == {i: (max(seqs[k][a:b]), a + seqs[k][a:b].index(max(seqs[k][a:b]))) for i, k, a, b in rows}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
