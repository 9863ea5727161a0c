"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connection, difference

from strandline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_queries_without_sql_are_tested_plainly():
    """Each of them has a brute-force version in test_documents."""
    from test_documents import PLAIN

    assert set(QUERIES) - set(ORACLES) == {*PLAIN, "document_common_prefix", "document_matches", "text_fuzzy_items"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
