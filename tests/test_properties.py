"""Brute-force properties on small random sequences, bits and texts."""

import random
from collections import Counter

import numpy as np
import pytest

from strandline.functions import kernels, patterns
from strandline.operators import bits, ranges, search, sequence, suffix
from strandline.plans import gram_index
from strandline.plans.blocks import edge_rows, full_blocks
from strandline.plans.ranking import global_positions


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    seqs = {k: [rng.randrange(6) for _ in range(n)] for k, n in (("a", 1), ("b", 7), ("c", 40), ("d", 97))}
    rows = [(k, i, v) for k, s in seqs.items() for i, v in enumerate(s)]
    s = spark.createDataFrame(rows, "seq_id string, pos long, val int").cache()
    asked = []
    for k, v in seqs.items():
        for _ in range(25):
            i, j = sorted(rng.sample(range(len(v) + 1), 2))
            asked.append((len(asked), k, i, j, rng.randrange(j - i), rng.randrange(-1, 7), rng.randrange(6), rng.randrange(8)))
    q = spark.createDataFrame(asked, "qid int, seq_id string, start long, end long, k int, value int, min_value int, max_value int").cache()
    return seqs, s, asked, q


def answers(df, *names):
    return {r["qid"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 8, 4096])
def test_ranges_by_blocks(data, block):
    seqs, s, asked, q = data
    low, high = answers(ranges.range_min(s, q, block=block), "value", "index"), answers(ranges.range_max(s, q, block=block), "value", "index")
    total, order = answers(ranges.range_aggregate(s, q, "sum", block=block), "value"), answers(ranges.range_fold(s.withColumn("val", s.val.cast("string")), q, lambda a, b: search.F.concat(a, b), block=block), "value")
    rank = answers(sequence.rank(s, q.withColumn("k", q.end), block=block), "rank")
    for qid, k, i, j, _, value, _, _ in asked:
        part = seqs[k][i:j]
        assert low[qid] == (min(part), i + part.index(min(part))) and high[qid] == (max(part), i + part.index(max(part)))
        assert total[qid] == (sum(part),) and order[qid] == ("".join(map(str, part)),)
        assert rank[qid] == (seqs[k][:j].count(value),)


def test_every_position_is_met_once(data):
    seqs, s, asked, q = data
    met = Counter((r["qid"], r["pos"]) for r in edge_rows(s, q, 8).collect())
    for r in full_blocks(q, 8).collect():
        met.update((r["qid"], p) for p in range(r["__block"] * 8, r["__block"] * 8 + 8))
    assert met == Counter((a[0], p) for a in asked for p in range(a[2], a[3]))


def test_sequence_queries(data):
    seqs, s, asked, q = data
    count, freq = answers(sequence.range_count(s, q), "count"), answers(sequence.range_freq(s, q), "count")
    quantile, mode = answers(sequence.quantile(s, q), "value"), answers(sequence.range_mode(s, q), "value", "frequency")
    less, more = answers(sequence.smaller_value(s, q, default=-9), "value", "found"), answers(sequence.larger_value(s, q), "value", "found")
    top = {}
    for r in sequence.top_k(s, q).collect():
        top.setdefault(r["qid"], {})[r["place"]] = (r["value"], r["frequency"])
    place = answers(sequence.select(s, q.withColumn("k", q.k + 1)), "position")
    for qid, k, i, j, at, value, lo, hi in asked:
        part = seqs[k][i:j]
        ranked = sorted(Counter(part).items(), key=lambda x: (-x[1], -x[0]))
        assert count[qid] == (part.count(value),) and freq[qid] == (sum(lo <= x < hi for x in part),)
        assert quantile[qid] == (sorted(part)[at],) and mode[qid] == ranked[0]
        assert less[qid] == (max((x for x in part if x < value), default=-9), any(x < value for x in part))
        assert more[qid] == (min((x for x in part if x > value), default=None), any(x > value for x in part))
        assert [top.get(qid, {})[n] for n in sorted(top.get(qid, {}))] == ranked[:at]
        found = [p for p, x in enumerate(seqs[k]) if x == value]
        assert place[qid] == (found[at] if at < len(found) else None,)


def test_bits(spark, data):
    seqs, s, asked, q = data
    b = s.selectExpr("seq_id", "pos", "val % 2 = 0 as bit")
    wide = q.withColumn("k", q.k * 5 - 3)
    r1, r0 = answers(bits.rank1(b, wide), "rank"), answers(bits.rank0(b, wide), "rank")
    s1, s0, got = answers(bits.select1(b, wide), "position"), answers(bits.select0(b, wide), "position"), answers(bits.get(b, wide), "bit")
    for qid, k, *_ in asked:
        x, at = [v % 2 == 0 for v in seqs[k]], asked[qid][4] * 5 - 3
        c = min(max(at, 0), len(x))
        ones, zeros = [i for i, v in enumerate(x) if v], [i for i, v in enumerate(x) if not v]
        assert r1[qid] == (sum(x[:c]),) and r0[qid] == (c - sum(x[:c]),)
        assert s1[qid] == (ones[at - 1] if 1 <= at <= len(ones) else None,) and s0[qid] == (zeros[at - 1] if 1 <= at <= len(zeros) else None,)
        assert got[qid] == (x[at] if 0 <= at < len(x) else None,)
    assert sorted(map(tuple, bits.unpack(bits.pack(b)).collect())) == sorted(map(tuple, b.collect()))


def test_global_positions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = global_positions(spark.createDataFrame(rows, "a int, b int").repartition(9), ["a", "b"], "p").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["p"])] == sorted(rows) and sorted(r["p"] for r in got) == list(range(500))


TEXTS = ["", "a", "aaaa", "abababab", "mississippi", "éaé\U0001f600é", "x.y*z\\Qq\\E", "aab" * 30]


def test_kernels():
    rng = random.Random(4)
    for t in TEXTS + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 70))) for _ in range(40)]:
        codes = kernels.code_points(t)
        order, lcp = kernels.suffix_order(codes)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert order.tolist() == want
        assert lcp.tolist() == [0][: len(t)] + [common(t[i:], t[j:]) for i, j in zip(want, want[1:])]
        closed = kernels.code_points(t + "\0")
        o, _ = kernels.suffix_order(closed)
        assert kernels.invert_bwt(closed[o - 1], int(np.flatnonzero(o == 0)[0])).tolist() == closed.tolist()
        seen, phrases, i = set(), 0, 0
        while i < len(t):
            n = 1
            while i + n <= len(t) and t[i : i + n] in seen:
                n += 1
            if i + n <= len(t):
                seen.add(t[i : i + n])
                phrases += 1
            i += n
        assert kernels.lz78(codes) == phrases
        pal = [(i, j - i) for i in range(len(t)) for j in range(i + 2, len(t) + 1) if t[i:j] == t[i:j][::-1]]
        assert kernels.longest_palindrome(t) == (min(pal, key=lambda p: (-p[1], p[0])) if pal else None)


@pytest.mark.parametrize("deletion,insertion,wild", [(True, True, None), (False, True, None), (True, False, "?"), (False, False, "?")])
def test_fuzzy_kernel(deletion, insertion, wild):
    rng = random.Random(8)

    def distance(p, w):  # no match starts with an inserted character
        far = 99
        d = [[far] * (len(w) + 1) for _ in range(len(p) + 1)]
        d[0][0] = 0
        for i in range(1, len(p) + 1):
            for j in range(len(w) + 1):
                best = d[i - 1][j] + 1 if deletion else far
                if j:
                    best = min(best, d[i - 1][j - 1] + (0 if p[i - 1] == w[j - 1] or p[i - 1] == wild else 1))
                    if insertion:
                        best = min(best, d[i][j - 1] + 1)
                d[i][j] = best
        return d[-1][-1]

    for _ in range(60):
        t, p, k = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))), "".join(rng.choice("ab?" if wild else "ab") for _ in range(rng.randrange(1, 5))), rng.randrange(3)
        want = []
        for i in range(len(t) + 1):
            options = [(distance(p, t[i : i + n]), abs(n - len(p)), n) for n in range(len(t) - i + 1)]
            best = min(options)
            if best[0] <= k:
                want.append((i, best[2], best[0]))
        got = kernels.fuzzy(kernels.code_points(t), kernels.code_points(p), k, deletion, insertion, ord(wild) if wild else None)
        assert list(zip(*[x.tolist() for x in got])) == want, (t, p, k)


def test_search_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id int, text string").cache()
    for p in ["a", "aa", "abab", "ss", "é", "\U0001f600", ".", "*", "\\Q", "\\E", "y*z\\Qq", "ba", "zz"]:
        want = {(i, k) for i, t in enumerate(TEXTS) for k in range(len(t)) if t.startswith(p, k)}
        assert {tuple(r) for r in search.locate(docs, p).collect()} == want, p
        assert {r[0]: r[1] for r in search.count_occurrences(docs, p).collect() if r[0] != 99} == {i: sum(w[0] == i for w in want) for i in range(len(TEXTS))}
        assert {r[0]: r[1] for r in search.find_first(docs, p).collect() if r[1] is not None} == {i: min(k for j, k in want if j == i) for i, _ in want}
    each = Counter(tuple(r) for r in search.locate_each(docs, ["a", "aa", ""]).collect())
    assert each == Counter((i, p, k) for p in ("a", "aa") for i, t in enumerate(TEXTS) for k in range(len(t)) if t.startswith(p, k))


def chain(text, pattern):
    """Greedy wildcard search, one part after another."""
    parts = [p for p in pattern.strip("*").split("*") if p]
    fits = lambda p, at: at + len(p) <= len(text) and all(c in ("?", text[at + i]) for i, c in enumerate(p))
    out = []
    for start in range(len(text)):
        if fits(parts[0], start):
            at = start + len(parts[0])
            for p in parts[1:]:
                nxt = next((k for k in range(at, len(text)) if fits(p, k)), None)
                if nxt is None:
                    break
                at = nxt + len(p)
            else:
                out.append((start, at - start))
    return out


def test_wildcards(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").cache()
    for p in ["a*b", "a?*b", "*s*i*", "i??i", "a*a*a", "x.y*q", "é*é"]:
        got = sorted(tuple(r) for r in search.search_wildcard(docs, p).collect())
        assert got == sorted((i, *m) for i, t in enumerate(TEXTS) for m in chain(t, p)), p
    assert patterns.wildcard("**") is None


def plain_hits(asked, texts):
    return sorted((n, -1 if i is None else i, k) for n, p in asked if p for i, t in texts for k in range(len(t or "")) if t.startswith(p, k))


def hits_of(df):
    return sorted((r["qid"], -1 if r["doc_id"] is None else r["doc_id"], r["position"]) for r in df.collect())


@pytest.mark.parametrize("gram,window", [(2, 3), (8, 8)])
def test_gram_index(spark, tmp_path, gram, window):
    """Located and counted, from a built, a grown and a loaded index, of any length;
    rows with null and repeated ids stay apart."""
    rng = random.Random(6)
    texts = list(enumerate(TEXTS)) + [(None, "a null id: mississippi mississippi"), (None, "mississippi"), (1, "another row of one"), (7, None)] + [(100 + i, "".join(rng.choice("ab c") for _ in range(rng.randrange(80)))) for i in range(30)]
    asked = ["ssi", "aba", "zzz", "aab" * 7, "z\\Q", "ab", "mississippi", "sissippi miss", "", None, "abababab", "row of one", texts[15][1][:40], texts[-1][1]]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, pattern string")
    want = plain_hits(enumerate(asked), texts)
    index = gram_index.build(docs, gram, window)
    assert hits_of(index.locate(q)) == want
    counts = {r["qid"]: r["count"] for r in index.count(q).collect()}
    assert counts == {n: sum(w[0] == n for w in want) for n in range(len(asked))}
    first = docs.filter("doc_id % 2 = 0")
    rest = docs.filter("doc_id % 2 = 1 or doc_id is null")
    assert hits_of(gram_index.build(first, gram, window).append(rest).locate(q)) == want
    path = f"{tmp_path}/grams"
    gram_index.build(first, gram, window).save(path)
    gram_index.append_to(spark, path, rest)
    again = gram_index.load(spark, path)
    assert (again.gram, again.window) == (gram, window) and hits_of(again.locate(q)) == want


def test_gram_index_arguments(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    with pytest.raises(ValueError):
        gram_index.build(docs, 3)
    q = spark.createDataFrame([(1, "abcdefghijklmnopq"), (2, "a")], "qid int, pattern string")
    assert gram_index.build(docs).locate(q).count() == 0


def test_many_hits_in_one_text(spark):
    """Positions take time in proportion to the hits."""
    text = "ab" * 150_000
    docs = spark.createDataFrame([(1, text), (2, "b" + text)], "doc_id int, text string")
    for i, (first, n) in {1: (0, 150_000), 2: (1, 150_000)}.items():
        got = [r["position"] for r in search.locate(docs.filter(f"doc_id = {i}"), "ab").collect()]
        assert got == list(range(first, first + 2 * n, 2))


def test_fuzzy_search_around_hits(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(120))) for _ in range(30)] + ["", "abc", "éabcdé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for pattern, k in (("abcdab", 1), ("abcabc", 2), ("ab", 1), ("a", 0)):
        got = sorted(tuple(r) for r in search.locate_fuzzy(docs, pattern, k).collect())
        want = [(i, *m) for i, t in enumerate(texts) for m in zip(*[x.tolist() for x in kernels.fuzzy(kernels.code_points(t), kernels.code_points(pattern), k)])]
        assert got == want


def test_tandem_kernel():
    rng = random.Random(9)
    for t in TEXTS + ["".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randrange(1, 60))) for k in range(150)]:
        best = {}
        for d in range(1, len(t) // 2 + 1):
            for p in range(len(t) - d):
                if t[p] == t[p + d] and (p == 0 or t[p - 1] != t[p + d - 1]):
                    x = next((x for x in range(len(t) - p - d) if t[p + x] != t[p + d + x]), len(t) - p - d)
                    if x >= d:
                        best[p] = max(best.get(p, (0, 0, 0)), ((x // d + 1) * d, -d, x // d + 1))
        assert kernels.tandem_repeats(kernels.code_points(t)) == [(p, -d, c) for p, (_, d, c) in sorted(best.items())], t


def test_rank_with_many_queries(spark):
    rng = random.Random(5)
    values = [rng.randrange(3) for _ in range(400)]
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "seq_id string, pos long, val int")
    asked = [(n, rng.choice(["s", "t"]), rng.randrange(500), rng.randrange(-1, 4)) for n in range(300)]
    q = spark.createDataFrame(asked, "qid int, seq_id string, k long, value int")
    got = {r["qid"]: r["rank"] for r in sequence.rank(s, q, block=16).collect()}
    assert got == {n: values[:k].count(v) if name == "s" else 0 for n, name, k, v in asked}


def test_occurrences_of_any_length(spark):
    texts = [*TEXTS, "a passage of the bench", "a passage of another kind", "the end: passage of the bench"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = ["passage of the bench", "a passage of the bench", "aba", "ab", "a", "é", "zzz", "", None, "ssi"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, pattern string")
    got = sorted(tuple(r) for r in gram_index.occurrences(docs, q).collect())
    assert got == sorted((n, i, k) for n, p in enumerate(asked) if p for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k))


def test_passages_are_whole(spark, tmp_path):
    """An item is found where its body stands, and not where only its opening does."""
    from strandline.plans.queries import QUERIES

    item = "the same opening and then a body of its own"
    spark.createDataFrame([(1, item), (2, "ab")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"x {item} y"), (2, "the same opening and then another body"), (3, "cab")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES["text_passages"](spark, str(tmp_path)).collect()) == [(1, 1, 2), (2, 3, 1)]


def test_common_grams(spark):
    from strandline.operators import compare

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = Counter(tuple(r) for r in compare.common_grams(docs, docs.filter("doc_id in (3, 4, 5)"), 2).collect())
    grams = lambda t: [(k, t[k : k + 2]) for k in range(len(t) - 1)]
    assert got == Counter((i, j, g, p, q) for i, s in enumerate(TEXTS) for j in (3, 4, 5) for p, g in grams(s) for q, h in grams(TEXTS[j]) if g == h)


def test_giant_suffixes(spark):
    text = "mississippi$mississippi"
    chars = spark.createDataFrame(list(enumerate(text)), "pos long, val string")
    got = [r["pos"] for r in sorted(suffix.giant_suffixes(chars).collect(), key=lambda r: r["rank"])]
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_texts_have_suffix_tables(spark):
    """Texts beyond max_chars, of null and repeated ids too, have the rows of the kernel."""
    from strandline.operators import repeats

    texts = [(1, "mississippi$mississippi"), (2, "aaaaaaaa"), (3, "short"), (4, ""), (5, None), (None, "abé😀abé😀ab"), (7, "abababab"), (8, "aaaaaaaa")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    split, whole = suffix.suffixes(docs, max_chars=6), suffix.suffixes(docs)
    assert split.schema == whole.schema
    assert Counter(tuple(r) for r in split.collect()) == Counter(tuple(r) for r in whole.collect())
    got = {r[0]: r[1] for r in repeats.count_unique_substrings(split).collect()}
    assert got == {r[0]: r[1] for r in repeats.unique_substrings(docs, max_chars=6).collect()} == {r[0]: r[1] for r in repeats.unique_substrings(docs).collect()}
    assert got == {i: len({t[a:b] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}) for i, t in texts if t}


def test_last_to_first(spark):
    docs = spark.createDataFrame([(1, "mississippi\0")], "doc_id int, text string")
    rows = sorted(suffix.last_to_first(suffix.bwt(docs)).collect(), key=lambda r: r["i"])
    last = [r["ch"] for r in rows]
    assert [r["lf"] for r in rows] == [sorted(range(len(last)), key=lambda i: (last[i], i)).index(i) for i in range(len(last))]


def test_streams(spark, tmp_path):
    from strandline.streaming import counts

    schema = "doc_id int, text string, ts timestamp"
    spark.sql("select 1 as doc_id, 'abcab' as text, timestamp'2024-01-01 00:00:00' as ts union all select 2, 'xab', timestamp'2024-01-01 00:20:00'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    counts.append_to(counts.grams(stream.select("doc_id", "text"), 2), f"{tmp_path}/grams", f"{tmp_path}/c1").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/grams").filter("gram = 'ab'").count() == 3
    q = counts.value_counts(stream, "doc_id", "text").writeStream.outputMode("complete").format("memory").queryName("vc").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from vc").collect()} == {(1, "abcab", 1), (2, "xab", 1)}
    windows = counts.windowed_counts(stream, "ts", "text", "5 minutes", "10 minutes")
    counts.append_to(windows, f"{tmp_path}/w", f"{tmp_path}/c3").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/w").count() >= 1
