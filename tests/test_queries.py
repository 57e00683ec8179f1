"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from barwright.registry import all_queries, all_sql
from harness import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) == ""


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
