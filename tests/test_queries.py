"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_registry():
    """The library's own queries all have SQL; every SQL has a query."""
    import queries

    assert set(queries.ORACLE) == set(queries.QUERIES) and set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    status, note = compare(spark, con, sf, entry.queries()[name], ORACLE.get(name))
    assert status != "FAIL", note
