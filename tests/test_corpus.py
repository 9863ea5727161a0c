"""Shared stretches and the order of suffixes against comparisons of all texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import prefix

from strandline.operators import corpus
from strandline.plans.suffix_order import suffix_order


def plain(rows, asked, least):
    """For each asked row its widest stretches, as (id, position, length)."""
    out = Counter()
    for k, (i, t) in enumerate(rows):
        if not asked(i) or not t:
            continue
        most = [max((prefix(t[p:], u[q:]) for j, (_, u) in enumerate(rows) if j != k and u for q in range(len(u))), default=0) for p in range(len(t))]
        out.update((i, p, n) for p, n in enumerate(most) if n >= least and (p == 0 or most[p - 1] != n + 1))
    return out


def corpora():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdeé \U0001f600") for _ in range(n))
    passage = word(25)
    rows = [(i if i % 7 else None, word(rng.randrange(5, 30)) + (passage[rng.randrange(8) :] if i % 3 == 0 else "") + word(6)) for i in range(20)]
    rows += [(0, passage), (50, rows[3][1]), (50, rows[3][1]), (100, "ab" * 30), (101, "ba" * 20), (150, "a" * 40), (151, "a" * 25), (152, ""), (200, None), (200, "ab")]
    return rows


@pytest.mark.parametrize("least", [3, 8, 13])
def test_shared_stretches(spark, least):
    rows = corpora()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, pos int").repartition(3)
    got = corpus.shared_stretches(docs, F.col("doc_id") % 50 == 0, least).collect()
    assert Counter(tuple(r)[:3] for r in got) == plain(rows, lambda i: i is not None and i % 50 == 0, least)
    for r in got:
        parts = {t[r["position"] : r["position"] + r["length"]] for i, t in rows if i == r["doc_id"] and t}
        assert parts & {t[r["other_position"] : r["other_position"] + r["length"]] for i, t in rows if i == r["other_id"] and t}


def test_nothing_shared(spark):
    docs = spark.createDataFrame([(0, "abcdefgh"), (1, "ijklmnop"), (2, None)], "doc_id int, text string")
    none = corpus.shared_stretches(docs, F.col("doc_id") % 50 == 0, 3)
    assert none.count() == 0 and none.columns == ["doc_id", "position", "length", "other_id", "other_position"]
    assert corpus.shared_stretches(docs.limit(0), F.lit(True), 3).count() == 0


@pytest.mark.parametrize("apart", [True, False])
def test_order(spark, apart):
    rng = random.Random(4)
    texts = ["a" * 150, "a" * 150, "ab" * 70, "".join(rng.choice("ab") for _ in range(120)), "x", "é\U0001f600" * 5] + ["".join(rng.choice("abcdefgh") for _ in range(60))]
    texts.append(texts[3][10:] + texts[-1])
    order = suffix_order(spark.createDataFrame(list(enumerate(texts)), "at long, text string"), apart)
    got = {(r["at"], r["pos"]): r["r"] for r in order.ranks.collect()}
    keys = {(i, p): ((i,) if apart else ()) + (t[p:],) for i, t in enumerate(texts) for p in range(len(t))}
    before = sorted(keys.values())
    assert got == {k: before.index(v) for k, v in keys.items()}
    pairs = [(*a, *b) for a, b in zip(rng.choices(list(keys), k=300), rng.choices(list(keys), k=300)) if a != b and (not apart or a[0] == b[0])]
    found = order.common_prefixes(spark.createDataFrame(pairs, "at1 long, pos1 long, at2 long, pos2 long")).collect()
    assert Counter(tuple(r) for r in found) == Counter((*p, prefix(texts[p[0]][p[1] :], texts[p[2]][p[3] :])) for p in pairs)


def test_a_round_moves_only_what_is_tied(spark):
    """Rows that are still tied fall from round to round, also beside one long repeat."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij") for _ in range(1000))
    text = long + "".join(rng.choice("abcdefghij") for _ in range(8000)) + long
    order = suffix_order(spark.createDataFrame([(0, text)], "at long, text string"), True)
    sizes = [t.count() for _, t in order.tied]
    assert all(n <= 2 * max(0, 1001 - k) for (k, _), n in zip(order.tied, sizes)) and sizes[-1] == 0


def test_copies_are_ordered_once(spark, monkeypatch):
    """Texts that are alike, and a passage across the border of two maps of positions."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    copy, passage = word(300), word(60)
    rows = [(i, copy) for i in range(40, 80)] + [(100, word(32_740) + passage + word(90)), (101, word(20) + passage), (102, passage + word(5))]
    seen = []

    def order(texts, apart):
        seen.append(texts.selectExpr("sum(length(text))").first()[0])
        return suffix_order(texts, apart)

    monkeypatch.setattr(corpus, "suffix_order", order)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(tuple(r)[:3] for r in corpus.shared_stretches(docs, F.col("doc_id") % 50 == 0, 40).collect())
    assert got == [(50, 0, 300), (100, 32_740, 60)]
    assert seen[0] < 1000


def test_grams_are_handed_over_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from strandline.plans import gram_index

    monkeypatch.setattr(gram_index, "HELD", 100)
    texts = ["".join(chr(97 + (i * k + i // 7) % 26) for i in range(60)) for k in range(1, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
    handed = []

    class Rows:
        """In place of a table: runs the worker's function here."""

        def __init__(self):
            self.schema = spark.createDataFrame([], "row long").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            handed.extend(run(iter([batch])))

    gram_index._least_grams(Rows(), ["row"], "text", 8, 8)
    assert len(handed) > 3 and max(pa.compute.sum(pa.compute.list_value_length(h.column(2))).as_py() for h in handed) < 160
    assert sorted(set(r for h in handed for r in h.column(0).to_pylist())) == list(range(len(texts)))


@pytest.mark.parametrize("least", [1, 3, 8, 13])
def test_lengths_are_tried(spark, monkeypatch, least):
    """What more characters take in place of the order of suffixes gives the same stretches."""
    monkeypatch.setattr(corpus, "_FEW", -1)
    monkeypatch.setattr(corpus, "suffix_order", None)
    rows = corpora()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = corpus.shared_stretches(docs, F.col("doc_id") % 50 == 0, least).collect()
    assert Counter(tuple(r)[:3] for r in got) == plain(rows, lambda i: i is not None and i % 50 == 0, least)
    for r in got:
        parts = {t[r["position"] : r["position"] + r["length"]] for i, t in rows if i == r["doc_id"] and t}
        assert parts & {t[r["other_position"] : r["other_position"] + r["length"]] for i, t in rows if i == r["other_id"] and t}
    assert corpus.shared_stretches(docs.limit(0), F.lit(True), least).count() == 0


def test_long_stretches_take_few_rounds(spark, monkeypatch):
    """Near copies of some thousand characters: no order of suffixes, four rounds of lengths, and few rows."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    changed = lambda at: base[:at] + "#" + base[at + 1 :]
    rows = [(0, base), (1, changed(5000)), (2, changed(7000)[100:7777]), (3, None), (4, base[:45])]
    tried, plain = [], corpus._tried

    def counted(*arguments):
        tried.append(plain(*arguments))
        return tried[-1]

    monkeypatch.setattr(corpus, "suffix_order", None)
    monkeypatch.setattr(corpus, "_tried", counted)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = sorted(tuple(r) for r in corpus.shared_stretches(docs, F.col("doc_id") % 50 == 0, 40).collect())
    assert got == [(0, 0, 5000, 1, 0), (0, 100, 6900, 2, 0), (0, 5001, 3999, 1, 5001)]
    assert len(tried) <= 4 and sum(t.count() for t in tried) < 2000
