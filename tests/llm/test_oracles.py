"""Corpus queries that SQL can express, against their SQL."""

import duckdb
import pytest
from corpora import documents
from oracle import connection, difference
from test_vectors import clustered
from test_vectors import table as vector_table

from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, connection(SF), QUERIES[name], ORACLES[name], SF) == ""


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, copies, near copies, ties, repeated and null ids, in a folder and as views."""
    folder = str(tmp_path_factory.mktemp("odd"))
    near = " ".join(f"w{i}" for i in range(60))
    extra = [(None, near, "en", "a"), (None, near + " end", "en", "a"), (5, near.upper(), "en", "b"), (5, "start " + near, None, "b"), (None, None, None, None)]
    documents(spark, extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    v = [1.0, 2.0, 3.0]
    rows = clustered() + [(1000, v, 0), (1000, v, 0), (None, v, 0), (1001, [2.0, 4.0, 6.0], 0), (1002, v, None), (1003, None, 0), (1004, [0.0, 0.0, 0.0], 0)]
    rows += [(1005, [1.0, None, 3.0], 0), (1006, [float("nan"), 2.0, 3.0], 0), (1007, [float("inf"), 2.0, 3.0], 0), (1008, [], 0), (1009, [1.0, 2.0], 0)]
    vector_table(spark, rows).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    from test_urls import ODD

    spark.createDataFrame([(i if i % 5 else None, u) for i, u in enumerate([u for u in ODD if u is None or "\n" not in u])], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    items = [(1, "the of Over w1 für"), (1, "the of Over w1 für"), (None, near), (2, None), (3, " - "), (4, "one \U0001f600 漢字"), (5, "and and and there")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_tables_match_sql(spark, odd, name):
    folder, con = odd
    assert difference(spark, con, QUERIES[name], ORACLES[name], folder) == ""


@pytest.mark.parametrize("name,least", [("op2_jaccard_groups", 20), ("op6_vector_duplicates", 100)])
def test_odd_tables_have_links(odd, name, least):
    assert odd[1].sql(f"SELECT count(*) FROM ({ORACLES[name]}) WHERE n_links > 0").fetchall()[0][0] >= least
