"""Every registered query against its SQL oracle on the smallest driver tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name)
    assert ok, text


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["entry_id", "term", "score", "score_text"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
