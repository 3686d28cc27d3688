"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from graphmill.plans import registry

from . import compare

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def sql(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, sql, name):
    got, want = compare.spark_rows(QUERIES[name](spark, data)), compare.sql_rows(sql, SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
