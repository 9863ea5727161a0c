import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from corpora import documents, empty

from strandline.llm import similarity


def plain(rows, words, threshold):
    """Every pair that shares a shingle, counted one by one: set size, component and links."""
    rows = list(rows)
    sets, copies = {}, Counter(doc for doc, _ in rows)  # a repeated row links with its copies
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}
    links = {d: copies[d] - 1 if sets[d] else 0 for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        common = defaultdict(int)
        for s in sets[d]:
            for e in holders[s]:
                common[e] += 1
            holders[s].append(d)
        for e, k in common.items():
            if threshold.denominator * k >= threshold.numerator * (len(sets[d]) + len(sets[e]) - k):
                links[d] += copies[e]
                links[e] += copies[d]
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


def check(spark, docs, words, threshold):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in similarity.similar_groups(docs, words, threshold).collect()}
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], words, threshold)
    return got


@pytest.mark.parametrize("words,threshold", [(4, Fraction(85, 100)), (5, Fraction(8, 10)), (2, Fraction(1, 2))])
def test_against_all_pairs(spark, words, threshold):
    got = check(spark, documents(spark).repartition(4), words, threshold)
    assert len({c for _, c, _ in got.values()}) < len(got)


def crowd(rng, n, size, changes, common=None):
    """Near copies of one text, some of them copies of changed copies."""
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out, seen = [], [base]
    for i in range(n):
        w = list(rng.choice(seen[-4:]) if i % 3 == 0 else base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        seen.append(w)
        out.append(" ".join(w + (common or [])))
    return out


def test_large_regions_in_chunks(spark, monkeypatch):
    """A crowd beyond a task's bound: chunks, balls and blocks give the same groups."""
    monkeypatch.setattr(similarity, "REGION_POINTS", 12)
    monkeypatch.setattr(similarity, "COUNT_POINTS", 16)
    rng = random.Random(3)
    texts = crowd(rng, 70, 60, 4) + crowd(rng, 50, 40, 3, ["a", "very", "common", "line", "of", "words"] * 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = check(spark, docs, 3, Fraction(8, 10))
    assert max(sum(c == k for _, c, _ in got.values()) for k in {c for _, c, _ in got.values()}) > 20


def test_recursion_in_a_region(spark):
    rng = random.Random(5)
    texts = crowd(rng, 150, 80, 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(spark, docs, 2, Fraction(8, 10))


def test_one_of_each(spark):
    docs = documents(spark)
    kept = similarity.one_of_each(docs, 5, Fraction(8, 10))
    groups = plain([(r["doc_id"], r["text"]) for r in docs.collect()], 5, Fraction(8, 10))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c, _) in groups.items() if c == d)


def test_odd_tables(spark):
    assert similarity.similar_groups(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "A  b\nc d e"), (1, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in similarity.similar_groups(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    links = sorted(((r["doc_id"] or -1), r["n_links"]) for r in similarity.similar_groups(docs).collect())
    assert links == [(-1, 3), (1, 3), (1, 3), (2, 3), (3, 0)]


def test_slices_give_the_texts_sets():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice("Ab cD éf".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "  X\ty "]
    whole = pa.array(texts)
    want = [s.tolist() for s in similarity.shingle_sets(whole, 3)]
    for at in (1, 57, 150):
        assert [s.tolist() for s in similarity.shingle_sets(whole.slice(at), 3)] == want[at:]
    assert [len(s) for s in want] == [n for n, _, _ in plain(enumerate(texts), 3, Fraction(1)).values()]


def test_steps_cover_a_batch_once(monkeypatch):
    import pyarrow as pa

    from strandline.llm import workspace

    monkeypatch.setattr(workspace, "STEP_BYTES", 50)
    texts = ["x " * (i % 40) for i in range(100)] + [None, "y" * 500, "", "z"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(workspace.text_steps([b, b.slice(0, 0)], 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts))) and len(parts) > 10
    sets = [s.tolist() for p in parts for s in similarity.shingle_sets(p.column(1), 3)]
    assert sets == [s.tolist() for s in similarity.shingle_sets(pa.array(texts), 3)]


@pytest.mark.parametrize("rounds", [1, 8])
def test_large_regions_in_rounds(spark, monkeypatch, rounds):
    """Crowds that several pivots separate, or that none does: splits and block pairs."""
    monkeypatch.setattr(similarity, "REGION_POINTS", 10)
    monkeypatch.setattr(similarity, "ROUNDS", rounds)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(4):  # most of each text is the passage, the rest its own crowd's
        own = [f"o{k}x{i}" for i in range(30)]
        for _ in range(25):
            w = passage + own
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(w + [f"t{i}" for i in range(rng.randrange(12))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = check(spark, docs, 2, Fraction(8, 10))
    assert len({c for _, c, _ in got.values()}) > 4


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join(base[:k] + [f"x{rng.randrange(10**6)}"] + base[k + 1 :])
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, " ".join(base)), (1, other), (None, near(3)), (None, near(30)), (5, other + " end"), (None, "alone here"), (None, None), (9, near(20)), (9, near(20))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, pid string")
    got = sorted(((r["doc_id"] or -1), r["component_id"] or -1) for r in similarity.similar_groups(docs, 2, Fraction(8, 10)).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 1), (-1, 1), (1, 1), (1, 1), (5, 1), (9, 1), (9, 1)]
    kept = similarity.one_of_each(docs, 2, Fraction(8, 10)).collect()
    assert sorted(((r["doc_id"] or -1), (r["text"] or "").split(" ")[0], r["pid"]) for r in kept) == [(-1, "", "s"), (-1, "alone", "s"), (1, "v0", "s"), (1, "w0", "s")]


def test_links_of_large_groups_with_copies(spark, monkeypatch):
    """Bands that are linked throughout, that cannot link, and blocks that are compared;
    copies count as often as they occur."""
    monkeypatch.setattr(similarity, "REGION_POINTS", 8)
    monkeypatch.setattr(similarity, "COUNT_POINTS", 8)
    rng = random.Random(11)
    texts = crowd(rng, 90, 120, 6) + crowd(rng, 60, 100, 1)
    texts += [rng.choice(texts) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = check(spark, docs, 2, Fraction(8, 10))
    assert len({links for _, _, links in got.values()}) > 10


def test_a_common_passage_pairs_no_blocks(spark, monkeypatch):
    """Texts that are half one passage elect again by the rest of them, so their blocks
    are not compared with each other; links among them are found all the same."""
    monkeypatch.setattr(similarity, "REGION_POINTS", 16)
    blocks, compared = similarity._block_pairs, []
    monkeypatch.setattr(similarity, "_block_pairs", lambda rows, *more: compared.append(rows.count()) or blocks(rows, *more))
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for k in range(150):
        own = [f"o{k}x{i}" for i in range(50)]
        texts.append(" ".join(passage + own))
        if k % 10 == 0:
            own[rng.randrange(50)] = "changed"
            texts.append(" ".join(passage + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = check(spark, docs, 4, Fraction(85, 100))
    assert sum(links for _, _, links in got.values()) == 30 and not sum(compared)


def test_sets_are_moved_once_to_their_names_and_once_to_their_regions(spark, monkeypatch):
    """No shuffle of the sets by point: copies go where the join by name has put them, and
    a set knows its regions."""
    save, plans = similarity.Workspace.save, {}

    def seen(self, df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name, *more)

    monkeypatch.setattr(similarity.Workspace, "save", seen)
    check(spark, documents(spark), 4, Fraction(85, 100))
    assert "Exchange hashpartitioning(k1" in plans["sets"] and "Exchange hashpartitioning(pid" not in plans["sets"]
    assert "Exchange hashpartitioning(region" in plans["links"] and "Join" not in plans["links"]
