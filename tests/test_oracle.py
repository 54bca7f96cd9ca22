"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry_point
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SQL = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    text, _, ok = compare(spark, duck, SF_DIR, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_flagship(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
