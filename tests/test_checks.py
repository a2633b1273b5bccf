"""Every registered query runs; those with check SQL give the same rows, columns and types in DuckDB."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) == ""
    else:
        assert len(df.toPandas()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 18


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
