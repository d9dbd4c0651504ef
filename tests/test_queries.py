"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import functools

import __spark_entry__ as E
import pytest
from oracle import by_duckdb, by_spark
from slotforge.queries import QUERIES, base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def slots_once():
    """The slot table is the same in all queries: keep it."""
    made = base.slots
    base.slots = functools.lru_cache(maxsize=1)(lambda spark, d: made(spark, d).persist())
    yield
    base.slots = made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = by_spark(spark, SF, QUERIES[name])
    sql = E.oracle_sql().get(name)
    if sql:
        assert found == by_duckdb(SF, sql)
    assert found[1]


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
