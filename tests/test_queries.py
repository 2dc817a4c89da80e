"""Every registered query that has SQL gives the SQL's rows."""

import pytest
from check_queries import compare, open_duckdb

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_duckdb(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    verdict, _, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
