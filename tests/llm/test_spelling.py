"""Spelling variants against plain comparisons of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from strandline.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows) -> Counter:
    found: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return Counter({w: n for w, n in found.items() if n >= 3})


def plain(rows):
    n = plain_words(rows)
    out = {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [w, form, None, n[w], len(others), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        row[2] = root
    return {tuple(r) for r in out.values()}


def corpus():
    rng = random.Random(5)
    stems = ["grammar", "separate", "aaaaaa", "aaaaaaa", "étrange", "straße", "übermut", "x×÷xxx", "receive", "ababab", "abababa", "long" * 40]
    letters = "abeé"

    def slip(w):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 1) :]

    rows = [(None, None), (1, ""), (2, "!!! 12 漢字"), (3, "y" * 50_000), (3, "y" * 50_000), (3, "y" * 50_000)]
    for i in range(120):
        ws = [rng.choice(stems) for _ in range(40)]
        ws = [slip(w) if rng.random() < 0.4 else w for w in ws]
        ws = [w.upper() if rng.random() < 0.1 else w for w in ws]
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "7", "\n"]).join(ws)))
    return rows + rows[-20:]


@pytest.mark.parametrize("block", [2, 20, spelling.BLOCK])
def test_variants(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, N string")
    got = spelling.variants(docs, block).collect()
    assert len(got) == len(set(got)) > 60 and set(map(tuple, got)) == plain(rows)


def test_crowds_of_one_half(spark):
    """Words that share a long beginning or end: large blocks are subdivided."""
    rng = random.Random(1)
    words = {("prefixprefix" + "".join(rng.choice("ab") for _ in range(12))) for _ in range(700)} | {"".join(rng.choice("ab") for _ in range(11)) + "suffixsuffix" for _ in range(500)}
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = [tuple(sorted((r[0], r[2]))) for r in spelling.near_pairs(table, 64).collect()]
    deleted: dict = {}
    for w in words:
        for i in range(len(w)):
            deleted.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    expected = {tuple(sorted((a, b))) for same in deleted.values() for a in same for b in same if a < b}
    expected |= {tuple(sorted((rest, w))) for (_, rest), longer in deleted.items() if rest in words for w in longer}
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 500


def test_the_letter_that_goes():
    run = next(w for w in (f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)) if zlib.crc32(f"7:{w}".encode()) % 97 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % len(run)
    assert spelling.slip("7", run) == run[:at] + run[at + 1 :] and spelling.slip("7", "kept") == "kept"


def test_no_rows(spark):
    out = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
