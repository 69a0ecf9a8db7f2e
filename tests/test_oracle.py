"""Every registered query with SQL, against DuckDB on the smallest folder."""

import pytest

import __spark_entry__ as entry

from .compare import connect, difference


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    assert not difference(entry.queries()[name](spark, small), con, entry.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
