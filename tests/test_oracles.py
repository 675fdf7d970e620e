"""Every query with SQL against DuckDB, every other one for rows (what rows is tested in test_plain_queries.py)."""

import oracle
import pytest

from vellum.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, data, con, name):
    assert oracle.compare(QUERIES[name](spark, data), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
