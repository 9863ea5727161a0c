import random
import zlib

import numpy as np
import pytest
from corpora import documents, empty, words

from strandline.llm import language, quality


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    return [(lang, words(rng, rng.randrange(8, 120), lang)) for lang in ("en", "de", "fr") for _ in range(60)]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 20):
        c = language.codewords(n)
        assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
        assert all(-n < s < n for s in c.sum(axis=0).tolist())
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_language_held_out(prose):
    model = language.fit(prose[::2])
    name, score, margin = language.predict(model, [t for _, t in prose[1::2]])
    assert np.mean([a == b for a, (b, _) in zip(name, prose[1::2])]) > 0.97
    assert ((score >= 0) & (score <= 1) & (margin <= score + 1e-9)).all()


def test_language_odd_texts(prose):
    model = language.fit(prose)
    name, score, _ = language.predict(model, [None, "", "12 !?", "½ ²", "a", "é", "x" * 300_000, "the " * 400_000])
    assert name[:4] == ["und"] * 4 and score[:4].tolist() == [0] * 4 and "und" not in name[4:]
    assert language.predict(language.fit([]), ["abc", None])[0] == ["und", "und"]
    one = language.predict(language.fit([("xx", "abc")]), ["hello", "1"])
    assert one[0] == ["xx", "und"] and one[1].tolist() == [1.0, 0.0]


def test_language_table(spark):
    docs = documents(spark)
    got = language.identify(docs, language.train(docs), columns=["doc_id", "n", "label"])
    assert got.columns == ["doc_id", "n", "label", "lang_pred", "score", "ambiguous"]
    rows = got.collect()
    assert len(rows) == docs.count() and {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {0, 1, 2, 7}
    clash = language.identify(docs.withColumnRenamed("x", "LANG_pred"), language.train(docs), columns=["doc_id", "LANG_pred", "text"]) if "x" in docs.columns else None
    assert clash is None or clash.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    assert language.identify(empty(spark), language.train(empty(spark))).count() == 0


def test_every_label_is_sampled(spark):
    from strandline.llm.sampling import drawn, fitted

    rows = [(i, f"text {i}", f"l{i % 90:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most, budget in ((300, 64 * 300), (300, 180), (300, 10), (3, 64 * 300)):
        taken = fitted(drawn(docs, "lang", most, max_texts=budget), lambda t: t.encode(), lambda pairs: pairs, 1 << 20)
        assert len({name for name, _ in taken}) == 90 and len(taken) <= max(90, min(budget, 90 * most))


def test_sample_depends_on_rows_only(spark):
    """Copies, null ids, long texts and the byte bound; the order of rows plays no part."""
    from strandline.llm.sampling import drawn, fitted

    rows = [(None, "same text", "a")] * 200 + [(1, f"one id {i}", "a") for i in range(60)] + [(i, f"b {i}", "b") for i in range(80)] + [(5, "z" * 300_000, "b"), (6, None, "b"), (7, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda df, most, size: fitted(drawn(df, "lang", most), lambda t: t.encode(), lambda pairs: pairs, size)
    one = take(docs, 20, 1 << 20)
    assert one == take(docs.repartition(7), 20, 1 << 20) and len(one) == len(set(one)) == 40
    every = take(docs, 300, 1 << 20)
    assert sorted(every) == sorted({(lang, text.encode()) for _, text, lang in rows if lang and text and len(text) < 1000})
    small = take(docs, 300, 200)
    assert 0 < sum(len(t) for _, t in small) <= 200 and {n for n, _ in small} == {"a", "b"}
    assert take(docs.limit(0), 20, 100) == []


def plain_language(model, text):
    """The n-gram shares of a text and the loss-weighted decoding, one by one."""
    import math

    b = (" " + text.lower() + " ").encode()
    fold = lambda x: x + 32 if 65 <= x <= 90 else 32 if x < 128 and not 97 <= x <= 122 else x
    b = [fold(x) for x in b]
    b = [x for i, x in enumerate(b) if i == 0 or x != 32 or b[i - 1] != 32]
    b += [32] * (3 - len(b))
    share, total = {}, 0
    for i in range(len(b) - 2):
        tri = b[i] << 16 | b[i + 1] << 8 | b[i + 2]
        for code, factor in ((tri, 0x9E3779B1), (tri >> 8 | 2 << 24, 0x85EBCA6B), (tri >> 16 | 1 << 24, 0xC2B2AE35)):
            k = (code * factor & 0xFFFFFFFF) >> (32 - language.BITS)
            share[k] = share.get(k, 0) + 1
            total += 1
    loss = []
    for i in range(len(model.languages)):
        loss.append(0.0)
        for k in range(model.code.shape[1]):
            margin = float(model.bias[k]) + sum(math.sqrt(n / total) * float(model.weights[h, k]) for h, n in share.items())
            loss[i] += float(model.trust[i, k]) * math.log1p(math.exp(-float(model.code[i, k]) * margin))
    p = [math.exp(-(x - min(loss)) * model.code.shape[1]) for x in loss]
    p = [x / sum(p) for x in p]
    best = min(range(len(p)), key=lambda i: (loss[i], model.languages[i]))
    rest = sorted(p)[-2] if len(p) > 1 else 0.0
    return model.languages[best], p[best], p[best] - rest


def test_language_against_plain_decoding(prose):
    model = language.fit(prose)
    texts = [t for _, t in prose[::7]] + ["a", "é ü", "Über die  Straße 12!?", "the und être", "mm" * 50]
    name, score, margin = language.predict(model, texts)
    for k, t in enumerate(texts):
        want = plain_language(model, t)
        assert name[k] == want[0] and abs(score[k] - want[1]) < 1e-3 and abs(margin[k] - want[2]) < 1e-3


def test_clear_and_good_documents(spark, prose):
    """Filters keep rows as they are; what is between two languages goes."""
    model = language.fit(prose)
    rng = random.Random(3)
    halves = [" ".join(x for pair in zip(words(rng, 40, "en").split(), words(rng, 40, "de").split()) for x in pair) for _ in range(40)]
    lead = lambda texts: language.predict(model, texts)[2]
    rows = [(i, t, "x", i) for i, t in enumerate([t for _, t in prose[:40]] + halves + [None, "", "123"])]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, lang_pred string, SCORE int")
    kept = language.clear(docs, model, 0.9)
    want = [i for i, t, _, _ in rows if t and any(c.isalpha() for c in t) and lead([t])[0] >= 0.9]
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == want
    assert all(i in want for i in range(40)) and len(want) < 80
    fitted = quality.fit(labelled(rng, 160))
    good = quality.good(docs, fitted, 0.5)
    assert good.schema == docs.schema and sorted(r["doc_id"] for r in good.collect()) == [i for i, t, _, _ in rows if fitted.score([t])[0] >= 0.5]


def test_language_learns_from_other_folds_only(spark):
    rng = random.Random(1)
    held = [i for i in range(900) if fold(i) == 2]
    rows = [(i, words(rng, 30, "de" if i % 2 else "en"), "secret" if fold(i) == 2 else ("de" if i % 2 else "en")) for i in range(400)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert held and model.languages == ["de", "en"]


def bad(rng):
    return "\n".join(" ".join(rng.choice(["BUY", "NOW!!", "$$$", "@@@", "win%%%"]) for _ in range(rng.randrange(3, 20))) for _ in range(rng.randrange(1, 5)))


def labelled(rng, n):
    return [("1", "\n".join(words(rng, rng.randrange(5, 30)).capitalize() + "." for _ in range(rng.randrange(1, 6)))) if i % 2 else ("0", bad(rng)) for i in range(n)]


def test_chain_against_enumeration():
    rng = np.random.default_rng(0)
    good, move, per_text = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([3, 1, 5])
    p, pairs = quality.marginals(good, per_text, move)
    at = 0
    for k, n in enumerate(per_text.tolist()):
        total, mass, count = 0.0, np.zeros(n), np.zeros(4)
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                count[2 * a + b] += w
        assert np.allclose(p[at : at + n], mass / total) and np.allclose(pairs[k], count / total)
        at += n


def test_long_chains_in_parts():
    """Chains of many lines, cut into parts, against plain recursion."""
    rng = np.random.default_rng(1)
    per_text, move = np.array([400, 1, 3, 90, 17]), rng.normal(size=(2, 2))
    good = rng.normal(size=per_text.sum())
    p, pairs = quality.marginals(good, per_text, move)
    at = 0
    for k, n in enumerate(per_text.tolist()):
        score = np.stack([np.zeros(n), good[at : at + n]], axis=1)
        a, b = score.copy(), np.zeros((n, 2))
        for t in range(1, n):
            a[t] += np.logaddexp(a[t - 1, 0] + move[0], a[t - 1, 1] + move[1])
        for t in range(n - 2, -1, -1):
            x = b[t + 1] + score[t + 1]
            b[t] = np.logaddexp(move[:, 0] + x[0], move[:, 1] + x[1])
        both = a + b
        assert np.allclose(1 / (1 + np.exp(both[:, 0] - both[:, 1])), p[at : at + n]) and np.isclose(pairs[k].sum(), n - 1)
        at += n


def test_long_texts_piece_by_piece(monkeypatch):
    rng = random.Random(4)
    model = quality.fit(labelled(rng, 160))
    text = "\n".join(t for _, t in labelled(rng, 50)) + "\n\n"
    want = model.raw([text])[0][0]
    for step in (1, 10, 100, 1000, 10**7):
        assert np.isclose(model.raw_long(text, step)[0], want)
    monkeypatch.setattr(quality, "_STEP", 500)
    texts = [text, None, "a\nb", text * 3, ""]
    several = model.score(texts)
    monkeypatch.setattr(quality, "_STEP", 10**9)
    assert np.allclose(several, model.score(texts))
    assert 0 <= model.score(["\n" * 300_000 + "ab"])[0] <= 1


def test_quality_held_out():
    rng = random.Random(4)
    model = quality.fit(labelled(rng, 160))
    test = labelled(rng, 100)
    s = model.score([t for _, t in test])
    y = np.array([name == "1" for name, _ in test])
    assert ((s >= 0.7) == y).mean() > 0.97 and ((s >= 0) & (s <= 1)).all()


def test_quality_follows_lines():
    rng = random.Random(4)
    model = quality.fit(labelled(rng, 160))
    mixed = words(rng, 40) + ".\n" + bad(rng)
    _, lines = model.raw([mixed])
    assert lines[0][0] > 0.5 > lines[0][-1]
    # equal texts, alone or together, have equal scores; odd texts have one
    odd = model.score([None, "", "\n\n", "a" * 200_000, mixed, mixed])
    assert np.isfinite(odd).all() and odd[4] == odd[5] and odd[0] == odd[1] and np.allclose(model.score([mixed]), odd[4])


def test_quality_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.train(docs, labels), columns=["doc_id", "n"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), none).count() == 0


def test_a_thousand_languages(spark):
    """Codewords by products in place of pairs; each language is learnt, also where its
    only text has more features than its share of the sample's bytes."""
    rng = random.Random(8)
    own = [[chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) + chr(0x100 + i % 300) for _ in range(6)] for i in range(1000)]
    rows = [(4 * i + j, " ".join(rng.choice(own[i]) for _ in range(40)), f"l{i:04d}") for i in range(1000) for j in range(2)]
    rows.append((9000, " ".join(chr(0x400 + rng.randrange(3000)) + str(k) for k in range(20_000)), "long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    learnt = sorted({r[2] for r in rows if fold(r[0]) != 2})
    assert model.languages == learnt and len(learnt) > 900
    code = language.codewords(1000)
    assert language._least_distance(code) == min(int((code[i] != np.delete(code, i, 0)).sum(axis=1).min()) for i in range(0, 1000))
    name, _, _ = language.predict(model, [r[1] for r in rows])
    seen = [(a, r[2]) for a, r in zip(name, rows) if fold(r[0]) != 2]
    assert np.mean([a == b for a, b in seen]) > 0.9


def test_shortened_features_are_the_strongest():
    code = language._encode("a quick text, " * 9)
    short = language._shortened(code, 60)
    at, x = np.frombuffer(short, "<u2", 10), np.frombuffer(short, "<f4", 10, 20)
    full = dict(zip(np.frombuffer(code, "<u2", len(code) // 6).tolist(), np.frombuffer(code, "<f4", len(code) // 6, len(code) // 3).tolist()))
    assert sorted(x.tolist()) == sorted(sorted(full.values())[-10:]) and all(full[k] == v for k, v in zip(at.tolist(), x.tolist())) and len(language._shortened(code, 1)) == 6
