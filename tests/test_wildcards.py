"""Wildcard search of many patterns against a plain version and one search a pattern."""

import random
from collections import Counter

import pytest

from strandline.functions.patterns import WildcardOptions
from strandline.operators import search, wildcards

OPTIONS = [
    WildcardOptions(),
    WildcardOptions(asterisk_min_length=1, asterisk_max_length=4),
    WildcardOptions(stop_characters=" \n"),
    WildcardOptions(asterisk="%", question="_", asterisk_min_length=2, asterisk_max_length=9, stop_characters="c]"),
]


def plain(text, pattern, o):
    """``(position, length)`` of every start: each gap takes the nearest next part."""
    parts = [p for p in pattern.split(o.asterisk) if p]
    if not parts or not text:
        return
    first_is_free = o.question not in parts[0] or not parts[0].strip(o.question)

    def stands(part, at, free):
        if at + len(part) > len(text):
            return False
        for p, c in zip(part, text[at:]):
            if (p != o.question and p != c) or (not free and c in o.stop_characters):
                return False
        return True

    for start in range(len(text)):
        if not stands(parts[0], start, first_is_free):
            continue
        end = start + len(parts[0])
        for part in parts[1:]:
            for at in range(end, min(len(text), end + o.asterisk_max_length) + 1):
                if at - end >= o.asterisk_min_length and stands(part, at, False):
                    end = at + len(part)
                    break
                if at < len(text) and text[at] in o.stop_characters:
                    end = None
                    break
            else:
                end = None
            if end is None:
                break
        if end is not None:
            yield start, end - start


def corpus(letters="abc \n]é"):
    rng = random.Random(8)
    word = lambda n, signs=letters: "".join(rng.choice(signs) for _ in range(n))
    docs = [(rng.choice([i, 3, None]), word(rng.randrange(40))) for i in range(14)] + [(1, ""), (2, None), (3, "abab"), (3, "abab"), (4, "a" * 30)]
    fixed = ["a*b", "ab", "a?", "a?b*c", "?", "??", "*", "", None, "??*a", "a*?*??*b", "a*??", "*a*", "?*?", "a**b", "a b*c", "?a*b?", "a*b*c*a", "a*b", " *a", "a*c", "zz*a", "a" * 25 + "*a", "a\\*b", "]*?a"]
    return docs, fixed + [word(rng.randrange(1, 5), "abc *?") for _ in range(25)]


@pytest.mark.parametrize("k", range(len(OPTIONS)))
def test_many_patterns(spark, monkeypatch, k):
    monkeypatch.setattr(wildcards, "SLICE", 7)
    o, (docs, patterns) = OPTIONS[k], corpus()
    patterns = [p and p.replace("*", o.asterisk).replace("?", o.question) for p in patterns]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, pid int")
    asked = spark.createDataFrame([(i % 30, p, "x") for i, p in enumerate(patterns)], "qid int, pattern string, at string")
    found = wildcards.search_wildcard_each(table, asked, o, block=5)
    assert found.columns == ["qid", "doc_id", "position", "length"]
    got = Counter(tuple(r) for r in found.collect())
    want = Counter((i % 30, d, *hit) for i, p in enumerate(patterns) if p for d, t in docs if t for hit in plain(t, p, o))
    assert got == want and got.total() > 100


def test_as_one_search_a_pattern(spark):
    docs, patterns = corpus()
    o = WildcardOptions(asterisk_max_length=12, stop_characters="\n")
    table = spark.createDataFrame(docs, "doc_id int, text string")
    patterns = [p for p in patterns[:12] if p]
    asked = spark.createDataFrame(list(enumerate(patterns)), "qid int, pattern string")
    got = Counter(tuple(r) for r in wildcards.search_wildcard_each(table, asked, o).collect())
    assert got == Counter((i, *r) for i, p in enumerate(patterns) for r in search.search_wildcard(table, p, o).collect())


def test_empty_tables_and_long_gaps(spark):
    table = spark.createDataFrame([(1, "x" + "a" * 20000 + "y\U0001f600b")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "x*y?b"), (2, "xa*b"), (3, "a?*\U0001f600")], "qid int, pattern string")
    got = Counter(tuple(r)[:1] for r in wildcards.search_wildcard_each(table, asked).collect())
    assert got == {(1,): 1, (2,): 1, (3,): 20000}
    assert wildcards.search_wildcard_each(table.limit(0), asked).count() == 0
    assert wildcards.search_wildcard_each(table, asked.limit(0)).count() == 0


def test_many_open_patterns_are_refused(spark):
    table = spark.createDataFrame([(1, "ab")], "doc_id int, text string")
    with pytest.raises(ValueError):
        wildcards.search_wildcard_each(table, spark.createDataFrame([(i, "?") for i in range(wildcards.OPEN + 1)], "qid int, pattern string"))


@pytest.mark.parametrize("k", range(len(OPTIONS)))
def test_texts_of_many_tasks(spark, monkeypatch, k):
    monkeypatch.setattr(wildcards, "SLICE", 7)
    monkeypatch.setattr(wildcards, "TOGETHER", 5)
    o, (docs, patterns) = OPTIONS[k], corpus()
    patterns = [p and p.replace("*", o.asterisk).replace("?", o.question) for p in patterns]
    table = spark.createDataFrame(docs, "doc_id int, text string")
    found = wildcards.search_wildcard_each(table, spark.createDataFrame(list(enumerate(patterns)), "qid int, pattern string"), o, block=5, max_chars=20)
    want = Counter((i, d, *hit) for i, p in enumerate(patterns) if p for d, t in docs if t for hit in plain(t, p, o))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_hits_of_single_letters_are_not_rows(spark, monkeypatch):
    made = []
    kept = wildcards.write_table
    monkeypatch.setattr(wildcards, "write_table", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    table = spark.createDataFrame([(i, "a" * 3000 + "word ab") for i in range(20)], "doc_id int, text string")
    found = wildcards.search_wildcard_each(table, spark.createDataFrame([(1, "word *a?")], "qid int, pattern string")).collect()
    assert sorted(map(tuple, found)) == [(1, i, 3000, 7) for i in range(20)]
    assert max(t.count() for _, t in made) <= 20
