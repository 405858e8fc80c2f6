"""Every named query next to its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as contract
from hallmark.plans import catalog

NAMES = sorted(catalog.queries())
QUERIES, SQL = contract.queries(), contract.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 20
