"""Every registered query, next to its SQL where it has one."""

import pytest

from compare import connect, mismatch
from conftest import SMALL

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert mismatch(QUERIES[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert {t for _, t in df.dtypes} <= {"bigint", "double", "string", "int", "boolean"}


def test_entry(spark):
    assert contract.entry(spark).count() == 6
