"""Approximate search of many patterns against one search a pattern."""

import random
from collections import Counter

import pytest

from strandline.functions import kernels
from strandline.operators import search
from strandline.operators.fuzzy import locate_fuzzy_each
from strandline.plans.queries import QUERIES


def corpus():
    rng = random.Random(12)
    word = lambda n, letters="abcdé \U0001f600": "".join(rng.choice(letters) for _ in range(n))
    patterns = [word(30), word(9), word(4), "ab", "a", "", None, word(70)]

    def slip(p):
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(p))
            p = p[:k] + rng.choice(["", "b", "cd"]) + p[k + rng.randrange(2) :]
        return p

    docs = [(rng.choice([i, 3, None]), word(15) + slip(rng.choice([patterns[0], patterns[1], patterns[7]])) + word(9)) for i in range(15)]
    return docs + [(1, ""), (2, None), (3, "abab"), (3, "abab")], patterns


@pytest.mark.parametrize("distance", [0, 2])
def test_many_patterns(spark, distance):
    docs, patterns = corpus()
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, row int")
    asked = spark.createDataFrame([(i % 5, p, "x") for i, p in enumerate(patterns)], "qid int, pattern string, pid string")
    got = Counter(tuple(r) for r in locate_fuzzy_each(table, asked, distance).collect())
    want = Counter()
    for i, p in enumerate(patterns):
        if p:
            want.update((i % 5, *r) for r in search.locate_fuzzy(table, p, distance).collect())
    assert got == want and got.total() > 20
    assert locate_fuzzy_each(table.limit(0), asked, distance).count() == 0 and locate_fuzzy_each(table, asked.limit(0), distance).count() == 0


def test_items_in_documents(spark, tmp_path):
    docs, patterns = corpus()
    items = [(i, p) for i, p in enumerate(patterns) if p is None or len(p) > 4]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in QUERIES["text_fuzzy_items"](spark, str(tmp_path)).collect())
    want = Counter((i, *r) for i, p in items if p for r in search.locate_fuzzy(table, p, 2).collect())
    assert got == want and got.total() > 10


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_texts_compared_together(monkeypatch, distance):
    """Many texts in a call of the kernel, at fewer starts, find what each text alone finds at all."""
    rng = random.Random(distance)
    word = lambda n: "".join(rng.choice("ab\U0001f600") for _ in range(n))
    for together in (1, 40, 10000):
        monkeypatch.setattr(kernels, "_TOGETHER", together)
        for _ in range(30):
            pattern, texts = word(rng.randrange(distance + 1, 12)), [word(rng.choice([0, 1, 5, 40])) for _ in range(6)]
            cut = [len(pattern) * k // (distance + 1) for k in range(distance + 2)]
            pieces = [(a, pattern[a:b]) for a, b in zip(cut, cut[1:])]
            codes = kernels.code_points(pattern)
            got = [r for part in kernels.fuzzy_each(texts, lambda t: kernels.near_hits(t, pieces, distance), codes, distance) for r in zip(*map(list, part))]
            assert got == [(i, *r) for i, t in enumerate(texts) for r in zip(*map(list, kernels.fuzzy(kernels.code_points(t), codes, distance)))]
    assert len(kernels.near_hits("xxabxxxx", [(0, "ab"), (2, "cd"), (4, "ef")], 2)) == 1  # nothing is before the first piece
