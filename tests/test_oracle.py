"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from thornwall.plans.queries import QUERIES

SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, db, sf, name):
    assert compare(spark, db, sf, name, entry.queries()[name], SQL[name]) is None


def test_queries_without_sql_return_rows(spark, sf):
    for name, run in QUERIES.items():
        if name not in SQL:
            assert run(spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "injection_score" in df.columns
