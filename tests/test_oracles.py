"""Every query with SQL must give the same rows as DuckDB on the whole tables."""

import pytest

from tools.check_oracles import compare, connect
from veiltab.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    problem, rows = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert problem is None
    assert rows > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
