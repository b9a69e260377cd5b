"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "pattern", "num_after_filter", "match_count"] and df.count() == 400
