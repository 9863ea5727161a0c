import hashlib
import zlib
from collections import Counter

import pytest
from corpora import documents, empty
from pyspark.sql import functions as F

from strandline.llm import media, sharding
from strandline.llm.workspace import Workspace


def test_lookup_table_by_turns():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    claimed, slots = {}, 101
    at = {s: 0 for s in shards}
    off = {s: int(hashlib.sha256(f"offset:{s}".encode()).hexdigest()[:16], 16) % slots for s in shards}
    skip = {s: int(hashlib.sha256(f"skip:{s}".encode()).hexdigest()[:16], 16) % (slots - 1) + 1 for s in shards}
    turn = 0
    while len(claimed) < slots:
        s = shards[turn % 7]
        while (p := (off[s] + at[s] * skip[s]) % slots) in claimed:
            at[s] += 1
        claimed[p], turn = turn % 7, turn + 1
    assert table == [claimed[k] for k in range(slots)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_leaving_moves_few_keys():
    shards = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(shards), sharding.lookup_table(shards[:-1])
    moved = sum(shards[x] != shards[y] for x, y in zip(a, b) if x != 19)
    assert moved < 0.15 * len(a)
    weighted = Counter(sharding.lookup_table(shards, weights={"s3": 3}))
    assert 2.8 < weighted[3] / weighted[4] < 3.2
    for bad in ((shards, 100), (["a", "a"], 101), ([], 101), (shards, 19)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_assign(spark, tmp_path):
    docs = documents(spark).withColumn("shard", F.lit("old"))
    got = sharding.assign(docs, "doc_id", ["x", "y", "z"])
    assert got.columns == [*documents(spark).columns, "slot", "shard"] and got.count() == docs.count()
    table = sharding.lookup_table(["x", "y", "z"])
    for r in got.collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r["slot"] == slot and r["shard"] == "xyz"[table[slot]]
    one = spark.createDataFrame([(None,), (None,)], "doc_id long")
    assert sharding.assign(one, "doc_id", ["x", "y", "z"]).select("shard").distinct().count() == 1
    assert sharding.assign(empty(spark), "doc_id", ["x"]).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    sharding.write_shards(got, f"{tmp_path}/out", parts=2)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 3


HTML = """<html><head><title>no</title><script>if (a < b) "<p>";</script></head><body><h1>Head &amp; foot</h1>
<p>One <b>two</b><br>three<p>unclosed <img src="a.png" alt="alt a"> after
<figure><img src="media:sha256/AB"><figcaption>The <i>caption</i></figcaption></figure>
<figure><figcaption>alone</figcaption></figure><video src="v.mp4"></video><img alt="no source">tail"""


def test_html_segments():
    got = [(s["position"], s["kind"], s["text"] or s["ref"], s["caption"]) for s in media.parse_html(HTML)]
    assert got == [
        (0, "text", "Head & foot", None),
        (1, "text", "One two three", None),
        (2, "text", "unclosed", None),
        (3, "media", "a.png", "alt a"),
        (4, "text", "after", None),
        (5, "media", "media:sha256/AB", "The caption"),
        (6, "text", "alone", None),
        (7, "media", "v.mp4", None),
        (8, "text", "tail", None),
    ]
    assert media.parse_html(None) == media.parse_html("") == []


def test_resolved_sequences_stay_aligned(spark):
    other = "<p>x</p><img src='media:sha256/cd?bytes=9'>"
    pages = spark.createDataFrame([(1, HTML, "x"), (2, None, "x"), (3, "", "x"), (None, "<p>a<img src='media:sha256/ab'>", "x"), (None, other, "x"), (1, HTML, "x"), (1, other, "x")], "page_id long, html string, digest string")
    facts = spark.createDataFrame([("ab", 5, 1), ("cd", 6, 2)], "digest string, size int, page int")
    got = media.resolve(media.parse_pages(pages), facts, Workspace(spark, "t")).collect()
    assert sorted((r["page_id"] or -1, len(r["segments"])) for r in got) == [(-1, 2), (-1, 2), (1, 2), (1, 9), (1, 9), (2, 0), (3, 0)]
    for r in got:
        for k, s in enumerate(r["segments"]):
            want = {"ab": 5, "cd": 6}.get((s["ref"] or "").lower().removeprefix("media:sha256/").partition("?")[0])
            assert (s["media"]["size"] if s["media"] else None) == want and s["position"] == k
    refs = media.references(media.parse_pages(pages)).filter("page_id = 1").collect()
    assert {r["caption"] for r in refs if r["digest"] == "ab"} == {"The caption"} and {r["n_bytes"] for r in refs} == {None, 9}


def plain_media(text):
    """What op4 says of a text, step by step."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    image = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()


def test_media_round_trip(spark):
    docs = documents(spark, [(None, "a <b> & c\nd </p> e\n\n f", "en", "a"), (400, "x\xff", "en", "a")])
    got = media.document_media(docs).collect()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((r["doc_id"], *plain_media(r["text"])) for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if x.strip(" ")]
        shown = [x for x in lines if x.strip()]
        assert r["n_texts"] == len(shown) and r["n_media"] == 2
        k = int(r["caption"].split()[2])
        assert r["caption"] == f"After paragraph {k} of {len(lines)}" and r["position"] == 1 + sum(bool(x.strip()) for x in lines[:k])
    assert len({r["position"] for r in got}) > 1
    assert media.document_media(empty(spark)).count() == 0


def test_bytes_that_are_no_text_keep_their_length(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab\xff\xff")), (2, bytearray(b"ab"))], "doc_id long, text binary")
    got = {r["doc_id"]: r["n_bytes"] for r in media.document_media(docs.selectExpr("doc_id", "cast(text as string) as text")).collect()}
    assert got == {1: 4, 2: 2}


def test_page_sequences(spark):
    rows = [(1, "u", HTML), (2, "u", None), (None, None, ""), (3, "v", "<p>only</p>"), (3, "v", "<p>only</p>")]
    got = media.page_sequences(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = []
    for key, url, html in rows:
        s = media.parse_html(html)
        texts = [x["text"] for x in s if x["kind"] == "text"]
        want.append((key, url, len(texts), len(s) - len(texts), sum(map(len, texts)), texts[0] if texts else None, texts[-1] if texts else None))
    assert Counter(map(tuple, got)) == Counter(want)


def test_damage_is_found(spark):
    space = Workspace(spark, "t")
    store = media.store_texts(documents(spark), space)
    bad = store.withColumn("media", F.concat(F.expr("substring(media, 1, length(media) - 1)"), F.lit(b"x")))
    with pytest.raises(Exception, match="does not match"):
        media.read_back(bad).collect()
    with pytest.raises(ValueError):
        media.from_image(b"P5\n24 2\n255\nxx")
