"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import lexical

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in own:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * len(own)) // total
            s = sum(times * math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scored[:k])]
    return Counter(out)


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "漢字", "x", "\U0001f600", "a\xa0b"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words[: rng.randrange(5, 66)]) for _ in range(n))
    docs = [(i if i % 9 else None, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, "copy W1 w2, w2") for i in range(90)] + [(7, "copy w1 w2 w2")] * 3 + [(None, "copy w1 w2 w2")] * 2
    docs += [(5, None), (6, ""), (8, " -- !"), (9, text(30_000)), (9, "W" * 40_000)]
    rng.shuffle(docs)
    items = [(0, "copy w2"), (1, "w1 w1 w7 é É"), (1, "w1 w1 w7 é É"), (None, "漢字 \U0001f600"), (2, None), (3, ""), (4, "unknown"), (5, text(500)), (6, "a\xa0b!"), (7, "w" * 40_000)]
    return docs, items


@pytest.mark.parametrize("postings,k,block", [(1, 20, 1), (200, 20, 1 << 18), (1 << 19, 3, 30)])
def test_search(spark, monkeypatch, postings, k, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = corpus()
    index = lexical.build(spark.createDataFrame([(*r, "n") for r in docs], "doc_id long, text string, Score string").repartition(5), postings)
    got = index.search(spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == plain(docs, items, k)


def test_saved_index(spark, tmp_path):
    docs, items = corpus()
    lexical.build(spark.createDataFrame(docs, "doc_id long, text string")).save(f"file://{tmp_path}/index")
    index = lexical.LexicalIndex.load(spark, f"file://{tmp_path}/index")
    got = index.search(spark.createDataFrame(items, "item_id long, text string"), 5)
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 5)


def test_ties_at_the_border_keep_the_least_ids():
    score, ids, known = np.array([5, 5, 9, 5, 5, 0]), np.array([40, 10, 99, 0, 20, 1]), np.array([True, True, True, False, True, True])
    assert sorted(lexical._best(score, ids, known, 3).tolist()) == [1, 2, 4]
    assert sorted(lexical._best(score, ids, known, 5).tolist()) == [0, 1, 2, 3, 4]


def test_no_rows(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.build(none).search(some).count() == 0
    out = lexical.build(spark.createDataFrame(docs, "doc_id long, text string")).search(some.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
