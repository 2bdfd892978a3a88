"""Every registered query equals its DuckDB twin at sf0.01
(row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from tools.oracle_check import compare, duck

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    from cohortlens.plans.registry import ORACLE, QUERIES
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    ok, msg = compare(spark, SF01, name, QUERIES[name], ORACLE[name], con)
    assert ok, msg
