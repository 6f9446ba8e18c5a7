"""Every registered query against its SQL twin in DuckDB, all rows, smallest tables."""

import pytest

import __spark_entry__ as registry
from checks.compare import connect, difference
from checks.queries import all_queries

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_library_query_has_a_twin():
    assert set(all_queries()) <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() == 80


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None
