"""The operators over documents against brute force on a few texts."""

import random

import pytest

from strandline.operators import suffix
from strandline.plans.queries import QUERIES

_rng = random.Random(4)
TEXTS = dict(enumerate([
    "then the enter men there with ten other entered north the end",
    "open threads enervate earth entire path erects the enth er th ",
    "abababab and abab and xyyx",
    "".join(_rng.choice("enrth ") for _ in range(400)),
    "aaaa",
    "z",
    "",
    None,
]))
TEXTS[20] = TEXTS[3]  # a copy


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def hits(t, p):
    return [i for i in range(len(t)) if t.startswith(p, i)]


def single(t):
    trails = hits(t, "th")
    for i in hits(t, "en"):
        trails = [x for x in trails if x > i + 2]
        if trails:
            at = trails.pop(0)
            yield i, at + 2 - i, 2, at - i - 2


def multi(t):
    for i in hits(t, "en"):
        b = next((x for x in hits(t, "er") if x >= i + 2), None)
        c = None if b is None else next((x for x in hits(t, "th ") if x >= b + 2), None)
        if c is not None:
            yield i, c + 3 - i, b - i - 2, c - b - 2


def places(t, size):
    at = {}
    for i in range(len(t) - size + 1):
        at.setdefault(t[i : i + size], []).append(i)
    return at


def longest(t):
    for size in range(len(t) - 1, 0, -1):
        if found := [(s, i) for s, at in places(t, size).items() if len(at) > 1 for i in at]:
            return found
    return []


def unique(t):
    for size in range(1, len(t) + 1):
        if found := [(s, at[0]) for s, at in places(t, size).items() if len(at) == 1]:
            return found
    return []


def tandem(t):
    best = {}
    for d in range(1, len(t) // 2 + 1):
        for p in range(len(t) - d):
            if t[p] == t[p + d] and (p == 0 or t[p - 1] != t[p + d - 1]):
                x = 0
                while p + d + x < len(t) and t[p + x] == t[p + d + x]:
                    x += 1
                if x >= d:
                    best[p] = max(best.get(p, (0, 0, 0, 0)), ((x // d + 1) * d, -d, d, x // d + 1))
    return [(p, d, n) for p, (_, _, d, n) in best.items()]


def palindrome(t):
    for size in range(len(t), 1, -1):
        for i in range(len(t) - size + 1):
            if t[i : i + size] == t[i : i + size][::-1]:
                return [(i, size)]
    return []


def prefix(a, b):
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def lz78(t):
    seen, n, i = set(), 0, 0
    while i < len(t):
        size = 1
        while i + size <= len(t) and t[i : i + size] in seen:
            size += 1
        if i + size <= len(t):
            seen.add(t[i : i + size])
            n += 1
        i += size
    return n


def intervals(t, least):
    same = {}
    for size in range(least, len(t)):
        for s, at in places(t, size).items():
            if len(at) > 1:
                same.setdefault(tuple(at), []).append(size)
    return [(at[0], min(sizes), max(sizes), len(at)) for at, sizes in same.items()]


PLAIN = {
    "document_repeat_intervals": lambda t: intervals(t, 8),
    "repeat_documents": lambda t: [(len({t[a:b] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}),)],
    "repeat_lz78": lambda t: [(lz78(t),)],
    "document_wildcard_q": lambda t: [(i,) for i in range(len(t) - 3) if t[i] == "e" and t[i + 3] == "n"],
    "document_single_gapped": single,
    "document_multi_gapped": multi,
    "document_longest_repeats": longest,
    "document_longest_repeat": lambda t: sorted({(s,) for s, _ in longest(t)})[:1],
    "document_shortest_unique": unique,
    "document_first_shortest_unique": lambda t: sorted(unique(t), key=lambda x: t[x[1] :])[:1],
    "document_tandem": tandem,
    "document_palindrome": palindrome,
}


@pytest.mark.parametrize("name", PLAIN)
def test_documents(spark, sf_dir, name):
    got = sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect() if TEXTS[r["doc_id"]])
    assert got == sorted((k, *row) for k, t in TEXTS.items() if t for row in PLAIN[name](t))


def test_common_prefixes(spark, sf_dir):
    got = {r["qid"]: r["lcp"] for r in QUERIES["document_common_prefix"](spark, sf_dir).collect()}
    assert got == {4 * k + j: prefix(t[len(t) * j // 4 :], t[len(t) - 1 - len(t) * j // 4 :]) for k, t in TEXTS.items() if t for j in range(4)}


def test_matches(spark, tmp_path):
    """Copies, passages and what they lie in, against comparisons of all texts."""
    from test_corpus import plain

    word = lambda n: "".join(_rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(60), word(45), word(39)]
    rows = [(i, word(50) + passages[i % 3][i % 5 :] + word(30)) for i in range(40, 70)] + [(100, passages[0]), (150, None), (200, word(70)), (201, "")]
    rows += [(300, rows[0][1]), (350, "ab" * 40), (351, "ba" * 35)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:3] for r in QUERIES["document_matches"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(plain(rows, lambda i: i % 50 == 0, 40).elements()) and len(got) > 4


def _lines_of(spark, operator, docs):
    return sorted(map(str, operator(docs).collect()))


@pytest.mark.parametrize("name", ["longest_repeated", "longest_repeat", "shortest_unique", "first_shortest_unique"])
def test_short_texts_need_no_suffix_table(spark, monkeypatch, name):
    """Texts up to max_chars are answered without a row a character; longer ones by their table."""
    from strandline.operators import repeats, suffix

    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    operator = getattr(repeats, name)
    mixed = _lines_of(spark, lambda d: operator(d, max_chars=30), docs)
    monkeypatch.setattr(suffix, "suffixes", None)  # a table would fail
    assert _lines_of(spark, operator, docs) == mixed


def test_pairs_of_short_texts_need_no_suffix_table(spark, monkeypatch):
    from strandline.operators import suffix

    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    rows = [(n, k, i, n % 7) for n, (k, i) in enumerate((k, i) for k in TEXTS for i in (-1, 0, 3, 50, None))] * 3
    q = spark.createDataFrame(rows, "qid long, doc_id long, i int, j int")
    monkeypatch.setattr(suffix, "_PAIRS", 2)
    mixed = _lines_of(spark, lambda d: suffix.lcp_of_pairs(d, None, q, max_chars=30), docs)
    expected = [(n, len(t) - i if i == j else prefix(t[i:], t[j:])) for n, k, i, j in rows if (t := TEXTS[k]) and i is not None and 0 <= i < len(t) and j < len(t)]
    monkeypatch.setattr(suffix, "suffixes", None)
    got = suffix.lcp_of_pairs(docs, None, q)
    assert sorted(map(tuple, got.collect())) == sorted(expected) and _lines_of(spark, lambda d: got, docs) == mixed


def test_documents_are_transformed_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "banana " * 3) for i in range(9)], "doc_id int, text string")
    looked, plain = [], type(docs).take
    monkeypatch.setattr(type(docs), "take", lambda df, n: looked.append(df._jdf.queryExecution().toString()) or plain(df, n))
    back = suffix.full_text_restore(docs)
    assert looked and not any("MapInArrow" in plan for plan in looked)
    assert [r["text"] for r in back.collect()] == ["banana " * 3] * 9


def test_tandem_repeats_and_intervals_of_long_repeats():
    import numpy as np

    from strandline.functions import kernels

    for text in ("x" * 33 + "y" + "x" * 33, ("ab" * 40 + "c") * 5, "".join(map(chr, range(40, 240))) * 3, "\U0001f600b" * 40):
        n = len(text)
        found = {}
        for d in range(1, n // 2 + 1):
            i = 0
            while i + d < n:
                k = i
                while k + d < n and text[k] == text[k + d]:
                    k += 1
                if k - i >= d:
                    found.setdefault(i, []).append((-(((k - i) // d + 1) * d), d, (k - i) // d + 1))
                i = k + 1
        want = sorted((i, min(v)[1], min(v)[2]) for i, v in found.items())
        assert kernels.tandem_repeats(kernels.code_points(text)) == want
    codes = kernels.code_points("abcdefgh-abcdefgh+abc")
    order, lcp = kernels.suffix_order(codes)
    assert kernels.lcp_intervals(lcp, order, np.ones(len(order), np.int64), 8).tolist() == [[0, -1, 8, 8, 2, 0]]


def test_tandem_repeats_order_a_plain_text_once(monkeypatch):
    from strandline.functions import kernels

    made, plain = [], kernels.Prefixes
    monkeypatch.setattr(kernels, "Prefixes", lambda codes: made.append(1) or plain(codes))
    text = "the cat sat on a mat, hummed and was asleep by noon " + "ab" * 30
    assert (52, 2, 30) in kernels.tandem_repeats(kernels.code_points(text))
    assert made == [1]
