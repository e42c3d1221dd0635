"""Every registered query that has SQL gives what DuckDB gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

from .conftest import SF_DIR, same

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_against_sql(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
