"""The golden cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from strandline.functions.patterns import WildcardOptions
from strandline.index import SequenceIndex, TextIndex, TextPair
from strandline.operators import ranges
from strandline.operators.search import SortOrder

FOX = "The quick brown fox jumps over the lazy dog. The quick brown dog jumps over the lazy fox."
GATTACA = "GATTACATACAGATTACA"


@pytest.fixture(scope="module")
def seq(spark):
    return SequenceIndex.create(spark, [3, 1, 4, 1, 5, 9, 2, 5, 3, 5, 8, 9])


@pytest.fixture(scope="module")
def letters(spark):
    return SequenceIndex.create(spark, "C,A,D,A,E,I,B,E,C,E,H,I".split(","))


@pytest.fixture(scope="module")
def fox(spark):
    return TextIndex.create(spark, FOX)


def test_access_rank_select(seq, letters):
    assert [seq.access(k) for k in (0, 4, 11)] == [3, 5, 9]
    assert (seq.rank(10, 5), seq.rank(5, 1), seq.rank(12, 7)) == (3, 2, 0)
    assert (seq.select(2, 5), seq.select(1, 4), seq.select(3, 1)) == (7, 2, None)
    assert letters.access(4) == "E" and letters.rank(5, "A") == 2 and letters.select(2, "A") == 3
    for bad in (lambda: seq.access(12), lambda: seq.rank(13, 1), lambda: seq.select(0, 1)):
        with pytest.raises(IndexError):
            bad()


def test_ranges(seq, letters):
    assert seq.range_count(5, 3, 10) == 3 and seq.range_count(1, 0, 4) == 2
    assert seq.quantile(0, 3, 10) == 1 and seq.quantile(3, 3, 10) == 5
    assert seq.range_freq(3, 6, 0, 12) == 6 and seq.range_freq(6, 3) == 0
    assert seq.range_mode(3, 10) == (5, 3)
    assert seq.top_k(3, 3, 10) == [(5, 3), (9, 1), (3, 1)] and seq.top_k(0) == []
    assert seq.smaller_value(4, 3, 10) == 3 and seq.smaller_value(1, 3, 10) is None
    assert seq.larger_value(4, 3, 10) == 5 and seq.larger_value(9, 3, 10) is None
    assert seq.smaller_value(1, 3, 10, default=2147483647) == 2147483647
    assert seq.try_larger_value(8) == (True, 9) and seq.try_smaller_value(1) == (False, None)
    assert letters.range_freq("C", "F", 0, 12) == 6 and letters.range_count("A", 0, 5) == 2
    with pytest.raises(IndexError):
        seq.range_count(5, 4, 4)


def test_successor_is_the_smallest_larger(spark):
    assert SequenceIndex.create(spark, [0, 2, 3]).larger_value(1) == 2


def test_range_minimum(spark):
    s = SequenceIndex.create(spark, [2, 3, 1, 4, 5, 2, 6, 1, 9])
    assert s.minimum(2, 7) == (1, 2) and s.maximum(1, 5) == (5, 4) and s.minimum() == (1, 2)
    assert s.aggregate("sum", 1, 4) == 8 and s.aggregate("sum") == 33
    assert s.fold(lambda a, b: a * 2 + b, 1, 4) == (3 * 2 + 1) * 2 + 4
    with pytest.raises(IndexError):
        s.minimum(10, 1)
    q = s._query(start=10, end=1)
    with pytest.raises(Exception, match="not inside"):
        ranges.range_min(s.data, q).collect()


def test_suffixes(spark):
    assert TextIndex.create(spark, "Hello World!").suffix_array() == [5, 11, 0, 6, 10, 1, 9, 2, 3, 4, 7, 8]
    assert TextIndex.create(spark, "abracadabra$").bwt() == ("ard$rcaaaabb", 3)
    t = TextIndex.create(spark, "abracadabra")
    assert [t.lcp(*p) for p in ((0, 7), (8, 1), (10, 7), (5, 5))] == [4, 3, 1, 6]
    g = TextIndex.create(spark, GATTACA)
    assert g.lcp(0, 11) == 7 and g.lcp(3, 14) == 4
    assert g.locate("TACA") == [3, 7, 14]


def test_exact_search(fox):
    assert fox.restore() == FOX
    assert fox.locate("dog") == [40, 61] and fox.locate("rabbit") == []
    assert fox.count("o") == 8 and fox.locate("o") == [12, 17, 26, 41, 57, 62, 71, 86]
    assert [fox.count(p) for p in ("fox", "The", "the", "cat", "")] == [2, 2, 2, 0, 0]
    assert fox.locate("quick") == [4, 49] and fox.locate("jumps", SortOrder.DESCENDING) == [65, 20]
    assert sorted(fox.locate("lazy", SortOrder.UNORDERED)) == [35, 80]
    assert fox.contains("lazy dog") and not fox.contains("cat") and not fox.contains("")
    assert fox.find_first("fox") == 16 and fox.find_first("cat") is None
    assert fox.unique_characters() == sorted(set(FOX))


def test_wildcards(spark, fox):
    assert fox.locate_fuzzy("lazy fax", 2) == [(80, 8, 1), (81, 7, 2)]
    assert fox.locate_fuzzy("?he", 0, True, True, "?") == [(0, 3, 0), (31, 3, 0), (45, 3, 0), (76, 3, 0)]
    assert fox.locate_wildcard("f_x", "_") == [16, 85]
    assert [m[:2] for m in fox.locate_single_gapped("T*q")] == [(0, 5), (45, 5)]
    assert [m[:2] for m in fox.locate_multi_gapped("T*q*b*n")] == [(0, 15), (45, 15)]
    assert [m[:2] for m in fox.locate_multi_gapped("T*q*b*n", False)] == [(0, 15), (0, 60), (0, 60), (0, 60), (45, 15)]
    a = TextIndex.create(spark, "axayazaaaa")
    assert a.search_wildcard("a?a") == [(0, 3), (2, 3), (4, 3), (6, 3), (7, 3)]
    assert a.search_wildcard("a*a") == [(0, 3), (2, 3), (4, 3), (6, 2), (7, 2), (8, 2)]
    q = TextIndex.create(spark, "The quiet little brown fox jumps over the lazy dog. The quick brown dog jumps over the lazy fox.")
    assert q.search_wildcard("qu*wn") == [(4, 18), (56, 11)]
    s = TextIndex.create(spark, "ab_a12b_a123b_a123456b_a1234567b")
    assert s.search_wildcard("a*b", WildcardOptions(asterisk_min_length=3, asterisk_max_length=6, stop_characters="_")) == [(8, 5), (14, 8)]
    for bad in (lambda: fox.locate_single_gapped("a*b*c"), lambda: fox.locate_multi_gapped("a*b", True, "*", "*"), lambda: fox.locate_fuzzy("a", -1), lambda: WildcardOptions(asterisk="?")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    "args,expected,key",
    [
        ((10, 5, 20), "e quick brown fox ju", 8),
        ((4, 5, 20), "The quick brown fox ", 4),
        ((80, 4, 20), "s over the lazy fox.", 11),
        ((20, 10, 10), "jumps over", 0),
        ((40, 3, 20, 0.9), " over the lazy dog. ", 15),
        ((5, 5, 20, 1.0), "The quick brown fox ", 5),
        ((80, 4, 20, 0.0), "s over the lazy fox.", 11),
    ],
)
def test_snippets(fox, args, expected, key):
    text, index, length, at = fox.snippet(*args)
    assert (text, at) == (expected, key) and FOX[index : index + length] == text


def test_repeats(spark, fox):
    assert fox.longest_repeated() == [(" jumps over the lazy ", [19, 64])]
    found = TextIndex.create(spark, "abcabcabc").search_repeated(3)
    assert found["abc"] == [0, 3, 6] and found["bca"] == [1, 4] and found["cab"] == [2, 5]
    none = TextIndex.create(spark, "abcdefghijk")
    assert none.search_repeated() == {} and none.longest_repeated() == [] and none.longest_repeat() is None
    assert TextIndex.create(spark, "abcxabcyabczabcabc").find_repeats(3) == {"abc": [0, 4, 8, 12, 15]}
    assert TextIndex.create(spark, "ababcxabcyabczabcabcbc").longest_repeat() == ("abc", [2, 6, 10, 14, 17])
    assert TextIndex.create(spark, "abcabcabcxyz").tandem_repeats() == [(0, 3, 3)]
    assert TextIndex.create(spark, "banana").count_unique_substrings() == 15
    assert TextIndex.create(spark, "abracadabra").lz78_complexity() == 7
    assert fox.shortest_unique() == (" T", 44)
    assert fox.all_shortest_unique() == [("x ", 18), ("g.", 42), (". ", 43), (" T", 44), ("g ", 63), ("x.", 87)]
    with pytest.raises(ValueError):
        fox.search_repeated(1)


def test_pairs(spark):
    p = TextPair(spark, "The quick brown fox jumps over the lazy dog.", "The lazy dog jumps over the quick fox.")
    assert p.longest_common() == [(" jumps over the ", [19], [12])]
    c = TextPair(spark, "abracadabra", "cadabras").common(4)
    assert sorted(c) == sorted("abra adab adabr adabra cada cadab cadabr cadabra dabr dabra".split()) and c["abra"] == ([0, 7], [3])
    assert TextPair(spark, "011000000", "999111999111").matches() == [(1, 9, 2), (1, 10, 2)]
    other = "The quick brown cat jumps over the lazy dog. The quick brown rabbit jumps over the lazy fox."
    assert TextPair(spark, FOX, other).longest_match() == (19, 19, 42)
    assert TextIndex.create(spark, "xabcdefggfedcbay").longest_palindrome() == (1, 14)
    assert TextIndex.create(spark, "abc").longest_palindrome() is None


def test_persistence(spark, seq, fox, tmp_path):
    from strandline.sources import store

    seq.save(f"{tmp_path}/seq")
    assert SequenceIndex.load(spark, f"{tmp_path}/seq").range_mode(3, 10) == (5, 3)
    fox.save(f"{tmp_path}/fox", "snappy")
    again = TextIndex.load(spark, f"{tmp_path}/fox")
    assert again.locate("dog") == [40, 61] and again.suffix_array() == fox.suffix_array()
    with pytest.raises(store.UnsupportedFormat):
        store.load(spark, f"{tmp_path}/seq", "text")
    with pytest.raises(store.UnsupportedFormat):
        store.load(spark, f"{tmp_path}/nothing", "text")
    with pytest.raises(store.IncompatibleType):
        store.load(spark, f"{tmp_path}/seq", "sequence", schemas={"data": fox.docs.schema})
    seq.data.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/seq/data")
    with pytest.raises(store.BrokenIndex):
        store.load(spark, f"{tmp_path}/seq", "sequence")


def test_tandem_forms_agree(spark):
    from strandline.operators import repeats

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaa", "abababcc", "", "xyzxyzxyxy", "éaéaéa"])], "doc_id int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "position", "length", "count").collect())
    assert rows(repeats.tandem_repeats(docs, 8)) == rows(repeats.tandem_repeats_sql(docs, 8))


def test_general_fold_keeps_order(spark, letters):
    assert letters.fold(lambda a, b: F.concat(a, b), 3, 8) == "AEIBE"
