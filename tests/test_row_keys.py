"""Every text operator on rows with null, repeated and equal ids: each row has the
results that it has alone."""

import random
from collections import Counter

import pytest
from test_documents import hits, intervals, longest, multi, palindrome, places, prefix, single, tandem, unique

from strandline.functions import kernels
from strandline.operators import compare, repeats, search, suffix
from strandline.plans import asof
from strandline.plans.keys import keyed

_rng = random.Random(8)
TEXTS = ["abab", "xyzxyz", "then the enter th north then er th ", "aaaa", "", None, "".join(_rng.choice("enrth ") for _ in range(150)), "z"]
ROWS = [(1, t) for t in TEXTS] + [(None, t) for t in TEXTS] + [(1, "abab"), (2, "abab"), (2, "abab")]


def all_repeats(t, least):
    return [(s, tuple(at)) for size in range(least, len(t)) for s, at in places(t, size).items() if len(at) > 1]


def grouped(found):
    out = {}
    for s, i in found:
        out.setdefault(s, []).append(i)
    return [(s, tuple(at)) for s, at in out.items()]


def first(found):
    return found[:1]


def all_multi(t):
    return [(i, c + 3 - i, b - i - 2, c - b - 2) for i in hits(t, "en") for b in hits(t, "er") if b >= i + 2 for c in hits(t, "th ") if c >= b + 2]


def gaps(df):
    return df.select("doc_id", "position", "length", df.gaps[0].gap_count, df.gaps[1].gap_count)


def suffix_rows(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    return [(r, i, prefix(t[order[r - 1] :], t[i:]) if r else 0) for r, i in enumerate(order)]


OPERATORS = {
    "locate": (lambda d: search.locate(d, "en"), lambda t: [(i,) for i in hits(t, "en")]),
    "locate_wildcard": (lambda d: search.locate_wildcard(d, "e?t"), lambda t: [(i,) for i in range(len(t) - 2) if t[i] == "e" and t[i + 2] == "t"]),
    "single_gapped": (lambda d: search.locate_single_gapped(d, "en*th"), single),
    "single_gapped_small_blocks": (lambda d: search.locate_single_gapped(d, "en*th", block=5), single),
    "multi_gapped": (lambda d: gaps(search.locate_multi_gapped(d, "en*er*th ")), multi),
    "multi_gapped_small_blocks": (lambda d: gaps(search.locate_multi_gapped(d, "en*er*th ", block=3)), multi),
    "multi_gapped_all": (lambda d: gaps(search.locate_multi_gapped(d, "en*er*th ", find_shortest=False)), all_multi),
    "suffixes": (suffix.suffixes, suffix_rows),
    "giant_suffixes": (lambda d: suffix.suffixes(d, max_chars=5), suffix_rows),
    "find_repeats": (lambda d: repeats.find_repeats(d, min_length=2), lambda t: all_repeats(t, 2)),
    "longest_repeated": (repeats.longest_repeated, lambda t: grouped(longest(t))),
    "longest_repeat": (repeats.longest_repeat, lambda t: first(sorted(grouped(longest(t))))),
    "shortest_unique": (repeats.shortest_unique, unique),
    "first_shortest_unique": (repeats.first_shortest_unique, lambda t: first(sorted(unique(t), key=lambda x: t[x[1] :]))),
    "repeat_intervals": (lambda d: repeats.repeat_intervals(d, 2), lambda t: intervals(t, 2)),
    "unique_substrings": (repeats.unique_substrings, lambda t: [(len({t[a:b] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}),)] if t else []),
    "tandem_repeats": (repeats.tandem_repeats, tandem),
    "longest_palindrome": (repeats.longest_palindrome, palindrome),
}


def transform(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    return [("".join(t[i - 1] for i in order), order.index(0))]


OPERATORS |= {
    "bwt": (suffix.bwt, transform),
    "giant_bwt": (lambda d: suffix.bwt(d, max_chars=5), transform),
    "restore": (suffix.full_text_restore, lambda t: [(t,)]),
    "giant_restore": (lambda d: suffix.full_text_restore(d, max_chars=5), lambda t: [(t,)]),
}
#: Of an empty text too.
WHOLE = {"bwt": ("", -1), "giant_bwt": ("", -1), "restore": ("",), "giant_restore": ("",)}


def plain(x):
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_apart(spark, name):
    run, expected = OPERATORS[name]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in ROWS], "doc_id int, text string, row string, rank int")
    got = run(docs)
    wanted = Counter((i, *row) for i, t in ROWS if t for row in map(tuple, expected(t)))
    wanted.update((i, *WHOLE[name]) for i, t in ROWS if t == "" and name in WHOLE)
    assert Counter(plain(tuple(r)) for r in got.collect()) == wanted
    none = run(docs.limit(0))
    assert none.count() == 0 and none.columns == got.columns and none.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_common_prefixes_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string")
    q = spark.createDataFrame([(7, 1, 0, 2), (8, None, 0, 2), (9, 1, 1, 1), (10, 3, 0, 0)], "qid int, doc_id int, i int, j int")
    got = Counter(tuple(r) for r in suffix.lcp_of_pairs(docs, None, q).collect())
    answer = lambda t, i, j: len(t) - i if i == j else prefix(t[i:], t[j:])
    assert got == Counter((qid, answer(t, a, b)) for qid, d, a, b in [(7, 1, 0, 2), (8, None, 0, 2), (9, 1, 1, 1)] for i, t in ROWS if i == d and t and max(a, b) < len(t))


def test_a_suffix_table_goes_with_keyed_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string")
    with pytest.raises(ValueError):
        repeats.longest_repeated(docs, suffix.suffixes(docs))
    own = keyed(docs)
    got = Counter(plain((r[0][1], *r[1:])) for r in repeats.longest_repeated(own, suffix.suffixes(own)).collect())
    assert got == Counter((i, *row) for i, t in ROWS if t for row in grouped(longest(t)))


PAIRS = [(1, "abcde", "zbcdz"), (1, "abcde", "zbcdz"), (None, "abab", "baba"), (None, "xx", "yy"), (1, "", "a"), (2, None, "a"), (1, "aaa", "aa")]


def common(a, b, least):
    out = []
    for size in range(least, min(len(a), len(b)) + 1):
        one, two = places(a, size), places(b, size)
        out += [(s, tuple(at), tuple(two[s])) for s, at in one.items() if s in two]
    return out


def neighbours(a, b):
    rows = sorted([(a[i:], 1, i) for i in range(len(a))] + [(b[i:], 2, i) for i in range(len(b))])
    return [((x, y)[p > q][2], (x, y)[p < q][2], prefix(x[0], y[0])) for x, y in zip(rows, rows[1:]) for p, q in [(x[1], y[1])] if p != q]


def test_pairs_stay_apart(spark):
    pairs = spark.createDataFrame([(*p, 1) for p in PAIRS], "pair_id int, text1 string, text2 string, rank int")
    sound = [(i, a, b) for i, a, b in PAIRS if a is not None and b is not None]
    rows = lambda df: Counter(plain(tuple(r)) for r in df.collect())
    assert rows(compare.common_substrings(pairs)) == Counter((i, *r) for i, a, b in sound for r in common(a, b, 2))
    assert rows(compare.longest_common(pairs)) == Counter((i, *r) for i, a, b in sound for r in common(a, b, 1) if len(r[0]) == max(len(x[0]) for x in common(a, b, 1)))
    assert rows(compare.matches(compare.pair_suffixes(pairs), 1)) == Counter((i, *r) for i, a, b in sound for r in neighbours(a, b) if r[2])
    found = {}
    for k, (i, a, b) in enumerate(sound):
        for s, one, two in common(a, b, 2):
            found.setdefault((k, i, one, two), []).append(len(s))
    assert rows(compare.common_intervals(pairs)) == Counter((i, one[0], two[0], min(sizes), max(sizes), len(one), len(two)) for (k, i, one, two), sizes in found.items())
    assert compare.common_intervals(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["find_repeats", "longest_repeated", "first_shortest_unique"])
def test_rows_stay_apart_in_small_blocks(spark, monkeypatch, name):
    """Neighbours and runs across the borders of blocks."""
    monkeypatch.setattr(asof, "BLOCK", 4)
    test_rows_stay_apart(spark, name)


def test_long_pairs_are_those_of_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK", 5)
    rng = random.Random(2)
    rows = PAIRS + [(9, "".join(rng.choice("ab") for _ in range(60)), "".join(rng.choice("abc") for _ in range(40))), (9, "é\U0001f600é", "\U0001f600é")]
    pairs = spark.createDataFrame(rows, "pair_id int, text1 string, text2 string")
    own = compare.keyed_pairs(pairs)
    rows_of = lambda df: Counter(plain(tuple(r)) for r in df.collect())
    assert rows_of(compare.pair_suffixes(own, max_chars=4)) == rows_of(compare.pair_suffixes(own))
    assert rows_of(compare.matches(compare.pair_suffixes(own, max_chars=4), 1)) == rows_of(compare.matches(compare.pair_suffixes(own), 1))


def test_palindromes_of_repetitive_texts(monkeypatch):
    rng = random.Random(6)
    texts = ["a" * n for n in (2, 3, 1500)] + ["".join(rng.choice("ab") for _ in range(300)) for _ in range(30)] + ["x" + "ab" * 600 + "y" + "ab" * 600]
    expected = [kernels.longest_palindrome(t) for t in texts]
    monkeypatch.setattr(kernels, "_grown", lambda c, steps: None)  # all by hashes
    assert [kernels.longest_palindrome(t) for t in texts] == expected
    for t in texts[3:10]:
        assert [kernels.longest_palindrome(t)] == (palindrome(t) or [None])
    assert kernels.longest_palindrome("ab") is None and kernels.longest_palindrome("") is None


def test_long_repetitive_texts_take_linear_time(spark):
    assert kernels.longest_palindrome("a" * 2_000_000) == (0, 2_000_000)
    text = "en th " * 40_000
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = search.locate_single_gapped(docs, "en*th").selectExpr("count(1)", "sum(gap_count)").first()
    assert tuple(got) == (40_000, 40_000)
    assert search.locate_multi_gapped(docs, "en*th*en").count() == 39_999
