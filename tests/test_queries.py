"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, QUERIES[name], SQL.get(name), SF_DIR)
    assert status in ("ok", "rows-only"), note
