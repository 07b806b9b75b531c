"""Every query with a SQL twin agrees with it; every other query gives rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, ok = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_twins_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
