"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0
