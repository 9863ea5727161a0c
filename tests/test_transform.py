"""Backward search on a kept transform against plain search."""

import random
from collections import Counter

import pytest

from strandline.plans import transform_index


def corpus():
    rng = random.Random(3)
    word = lambda n, letters="ab\0 é\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    texts = [word(rng.randrange(9)) for _ in range(12)] + ["abab", "abab", "a" * 8, "aaaa", "", None]
    docs = [(rng.choice([1, 2, i, None]), t) for i, t in enumerate(texts)]
    pieces = [t[k : k + rng.randrange(1, 5)] for t in texts if t for k in (0, len(t) // 2)]
    return docs, [*pieces, *"ab\0z", "aa", "a" * 8, "a" * 9, "bz", "zb", texts[0], "", None, "ab", "ab"]


def plain(docs, patterns):
    found = Counter()
    for q, p in patterns:
        for i, t in docs:
            if p and t:
                found.update((q, i, k) for k in range(len(t)) if t.startswith(p, k))
    return found


@pytest.mark.parametrize("rate, block", [(1, 1), (3, 8)])
def test_counts_and_places(spark, tmp_path, rate, block):
    docs, patterns = corpus()
    asked = [(i % 30, p) for i, p in enumerate(patterns)]
    schema = "doc_id int, text string, at int"
    table = lambda rows: spark.createDataFrame([(*d, 9) for d in rows], schema)
    q = spark.createDataFrame([(*a, 0) for a in asked], "qid int, pattern string, pid int")
    path = f"file://{tmp_path}/transform"
    transform_index.build(table(docs[:9]), rate, block).save(path)
    transform_index.append_to(spark, path, table(docs[9:]), rate)
    index = transform_index.load(spark, path)
    want = plain(docs, asked)
    assert Counter(tuple(r) for r in index.locate(q).collect()) == want and want.total() > 60
    counts = Counter((i, sum(plain(docs, [(i, p)]).values())) for i, p in asked)
    assert Counter(tuple(r) for r in index.count(q).collect()) == counts


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a"), (2, None)], "qid int, pattern string")
    nothing = transform_index.build(docs.filter("doc_id = 2"))
    assert nothing.locate(q).count() == 0 and sorted(map(tuple, nothing.count(q).collect())) == [(1, 0), (2, 0)]
    grown = nothing.append(docs)
    assert [tuple(r) for r in grown.locate(q).collect()] == [(1, 1, 0)]
    assert grown.locate(q.limit(0)).count() == 0 and grown.count(q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        transform_index.build(docs, 0)


def test_short_texts_need_no_joins(spark, monkeypatch):
    """Texts up to max_chars are ordered in groups, by one task each; longer ones by joins."""
    docs, patterns = corpus()
    table = spark.createDataFrame(docs, "doc_id int, text string")
    asked = list(enumerate(patterns))
    q = spark.createDataFrame(asked, "qid int, pattern string")
    counts = Counter((i, sum(plain(docs, [(i, p)]).values())) for i, p in asked)
    monkeypatch.setattr(transform_index, "GROUP", 5)
    both = transform_index.build(table, 2, 4, max_chars=4)
    assert Counter(tuple(r) for r in both.count(q).collect()) == counts
    monkeypatch.setattr(transform_index, "suffix_order", None)  # the order by joins would fail
    monkeypatch.setattr(transform_index, "_SENT", 10)
    assert Counter(tuple(r) for r in transform_index.build(table, 2, 4).count(q).collect()) == counts
