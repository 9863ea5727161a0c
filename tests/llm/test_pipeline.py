from collections import Counter

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"file://{root}/{name}")
        docs = spark.read.parquet(f"file://{root}/{name}")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "mix", "pack"]
    assert all(sorted(d.dtypes) == sorted(stages[0].dtypes) for d in stages[:5])


def test_filters_drop_the_bad_and_keep_the_good(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"] for r in stages[1].collect()}
    kept = {r["doc_id"] for r in stages[2].collect()}
    good, bad = {d for d in before if labels.get(d) == 1}, {d for d in before if labels.get(d) == 0}
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    letters = {r["doc_id"] for r in stages[0].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert len(before & letters) >= 0.97 * len(letters)


def test_one_of_each_group_stays(stages):
    from fractions import Fraction

    from test_similarity import plain

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    groups = plain(rows, 5, Fraction(8, 10))
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(d for d, (_, c, _) in groups.items() if c == d)


def test_mix_and_pack_take_effect(spark, stages):
    mixed = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(mixed) <= {r["doc_id"] for r in stages[3].collect()} and max(mixed.values()) <= 4
    pieces = stages[5].collect()
    assert {r["doc_id"] for r in pieces} == set(mixed)
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    again = corpus_pipeline.run(spark, SF)
    assert sum(r["length"] for r in again.collect()) == sum(r["length"] for r in pieces)
