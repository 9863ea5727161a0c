"""All registered queries and pipeline stages on odd tables: names and types of the
results, rows with null ids, copies, columns with clashing names, no rows."""

from collections import Counter

import corpus_pipeline
import pytest
from corpora import documents

from strandline.llm.queries import QUERIES

#: Names that results or steps in between have, in other cases as well.
CLASHES = "Lang_Pred score AMBIGUOUS p Slot shard Size position time epochs taken component_id n_shingles page row part Ids digest media held_out predicted k1 K2 pid low component region pivot near chunk __row __k1 __id __t1 start length lot label_ doc batch at feature target source_size before goal".split()

CONTRACT = {
    "op1_pack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_jaccard_groups": "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint",
    "op4_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_vector_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_line_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}
PER_ROW = {"op2_jaccard_groups", "op4_media", "op7_line_quality", "op8_language", "op9_mix", "op10_shard"}


def write(spark, root, empty=False):
    names = [c for c in CLASHES if c.lower() not in ("doc_id", "text", "lang", "source", "n_chars")]
    docs = documents(spark, [(None, "a text without an id, twice", "en", "a")] * 2 + [(None, None, None, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[docs.n_chars.cast("string").alias(c) for c in names])
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], "x" if i % 4 else None, "n") for i in range(60)] + [(None, None, "x", "n"), (None, [1.0, 1.0, 1.0], "x", "n"), (61, [], "y", "n"), (62, [0.0, float("nan")], "y", "n")], "vec_id long, embedding array<double>, label string, CID string")
    labels = spark.createDataFrame([(100 + i, i % 2, 0, "n") for i in range(40)] + [(None, 1, 0, "n"), (200, None, 0, "n")], "doc_id long, quality int, toxic int, Lot string")
    pages = spark.createDataFrame([(1, "u", "<p>a</p><img src='x'>", "n"), (None, None, None, "n"), (1, "u", "", "n"), (2, "http://A.Org/x", "", "n")], "page_id long, url string, html string, SEGMENTS string")
    items = spark.createDataFrame([(1, "the of w1", "n"), (1, "the of w1", "n"), (None, "straße", "n"), (2, None, "n"), (3, "", "n")], "item_id long, text string, Q string")
    for name, df in (("documents", docs), ("embeddings", vectors), ("labels", labels), ("pages", pages), ("benchmark", items)):
        (df.limit(0) if empty else df).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), empty=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, odd, none, name):
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").collect()
    got = QUERIES[name](spark, odd)
    if name in CONTRACT:
        kinds = dict(got.dtypes)
        assert {c: kinds[c] for c in kinds if f"{c} " in CONTRACT[name]} == dict(x.split(" ") for x in CONTRACT[name].split(", "))
    found = got.collect()
    assert len(found) > 0
    if name in PER_ROW:
        assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in rows)
    if name == "op1_pack":
        assert Counter(r["doc_id"] for r in found if r["start"] == 0) == Counter(r["doc_id"] for r in rows)
    if name == "op3_training_order":
        assert set(r["doc_id"] for r in rows) == {d for r in found for d in r["doc_ids"]}
    if "held_out" in got.columns:
        assert all(isinstance(r["held_out"], bool) for r in found)
    empty = QUERIES[name](spark, none)
    assert empty.count() == 0 and empty.columns == got.columns


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, odd, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = stage(spark, docs, odd)
    if name != "pack":
        assert out.dtypes == docs.dtypes
        whole = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in out.collect()} <= whole
    assert out.count() > 0
    assert stage(spark, docs.limit(0), none).count() == 0
