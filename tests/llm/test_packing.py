import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpora import documents, empty

from strandline.llm import lengths, ordering, packing, tokens
from strandline.llm.workspace import Workspace, new_path


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_gives_the_library_ids(slow):
    texts = ["", None, " lead", "tail ", "a  b\n\n c ", "don't we'll 12 ab12\t x", "\x1c a \x85 b", "<|endoftext|> hi", "漢字 \U0001f600 é", "x" * 3000, "the " * 5000, "a\n b", "word\xa0 x", "\n", " "]
    enc = tokens.encoder(tokens.default_path())
    flat, counts = enc.encode_batch(texts)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [slow.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert enc.encode_batch([])[0].tolist() == []


@pytest.mark.parametrize("length", [7, 256])
def test_pack_against_plain_version(spark, slow, length):
    docs = documents(spark).repartition(5)
    rows = docs.collect()
    stream = packing.open_stream(docs, Workspace(spark, "t"))
    got = [r.asDict() for r in packing.pieces(stream, length, with_ids=True).collect()]
    # every sequence is gapless, full but the last, and pieces restore all texts
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, parts in by_seq.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or k == len(by_seq) - 1
    want = defaultdict(list)
    for r in rows:
        want[r["doc_id"]].append(slow.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    for doc, texts in want.items():
        one = sorted(by_doc[doc], key=lambda r: (r["start"], r["sequence_id"]))
        assert sum(r["length"] for r in one) == sum(map(len, texts))
        if len(texts) == 1:
            ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in one])
            assert ids.tolist() == texts[0] and {r["doc_tokens"] for r in one} == {len(ids)}
    # the windows assembled with boundary records are the pieces' windows
    seqs = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(stream, length).collect()}
    for k, parts in by_seq.items():
        wide = np.frombuffer(seqs[k], f"<u{stream.width}").astype("<u4").tobytes()
        assert wide == b"".join(bytes(r["ids"]) for r in sorted(parts, key=lambda r: r["offset"]))


def test_empty_tables(spark):
    assert packing.pack(empty(spark)).count() == 0
    assert lengths.token_counts(empty(spark)).count() == 0
    assert ordering.materialise(empty(spark)).count() == 0


def test_length_histogram(spark, slow, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 16)
    docs = documents(spark)
    n = [len(slow.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    rows = lengths.token_counts(docs).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == {x: n.count(x) for x in n}
    for r in rows:
        k = r["n_tokens"]
        assert r["docs_below"] == sum(x < k for x in n) and r["tokens_below"] == sum(x for x in n if x < k)
        assert r["docs_reaching"] == sum(x >= k for x in n) and r["tokens_kept"] == sum(min(x, k) for x in n)
        assert r["tokens_kept"] + r["tokens_cut"] == r["tokens_total"] == sum(n)
        assert abs(r["quantile"] - sum(x <= k for x in n) / len(n)) < 1e-12
    at = {r["context"]: r for r in lengths.at_limits(lengths.histogram(docs), [1, 50, 10**6]).collect()}
    assert at[50]["tokens_kept"] == sum(min(x, 50) for x in n) and at[10**6]["docs_reaching"] == 0 and at[1]["tokens_cut"] == sum(n) - len(n)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = ordering.permute(x, n, key=9)
    assert sorted(y.tolist()) == x.tolist() and ordering.permute(y, n, key=9, inverse=True).tolist() == x.tolist()
    if n > 100:
        assert (y != ordering.permute(x, n, key=10)).any() and abs(np.corrcoef(x, y)[0, 1]) < 0.2


def test_shards_round_trip(spark):
    docs = documents(spark).repartition(3)
    stream = packing.open_stream(docs, Workspace(spark, "t"))
    shards, manifests = ordering.write_shards(stream, new_path(spark, "shards"), length=64, per_shard=100)
    done = {r["shard"]: r for m in manifests for r in m.collect()}
    assert len(manifests) == 3
    assert sum(r["records"] for r in done.values()) == shards.sequences and len(done) == shards.files
    want = {r["sequence_id"]: bytes(r["ids"]).ljust(64 * stream.width, b"\0") for r in packing.sequences(stream, 64).collect()}
    got = ordering.read_shards(spark, shards, with_ids=True).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in got} == want and sorted(r["slot"] for r in got) == list(range(shards.sequences))
    assert all(r["byte_offset"] == (r["slot"] - r["shard"] * 100) * shards.stride for r in got)
    later = ordering.read_shards(spark, shards, from_slot=150).collect()
    assert sorted(r["slot"] for r in later) == list(range(150, shards.sequences))
    again = {r["shard"]: r["crc32"] for m in manifests for r in m.collect()}  # written once more, equal
    assert again == {k: r["crc32"] for k, r in done.items()}


def test_materialised_members(spark, slow):
    """Every slot's sequence, bytes and documents, in full."""
    docs = documents(spark, [(None, "no id here", "en", "a"), (None, None, "en", "a")]).repartition(3)
    stream = packing.open_stream(docs, Workspace(spark, "t"))
    got = {r["sequence_id"]: r for r in ordering.materialise(docs, length=128, per_shard=16).collect()}
    want, at = defaultdict(list), 0
    raw = b""
    for r in sorted(stream.table.collect(), key=lambda r: (r["part"], r["start_in_part"])):
        for seq in range(at // 128, (at + r["n_tokens"] - 1) // 128 + 1):
            want[seq].append(r["doc_id"])
        at += r["n_tokens"]
        raw += bytes(r["ids"])
    n = len(want)
    slots = ordering.permute(np.arange(n), n, 42)
    assert {k: (r["slot"], r["doc_ids"]) for k, r in got.items()} == {k: (slots[k], want[k]) for k in want}
    for k, r in got.items():
        assert r["crc32"] == zlib.crc32(raw[k * 256 : (k + 1) * 256].ljust(256, b"\0")) and (r["shard"], r["byte_offset"]) == (r["slot"] // 16, r["slot"] % 16 * 256)
