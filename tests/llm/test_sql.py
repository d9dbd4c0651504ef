"""The queries with SQL give the rows that DuckDB gives."""

import pytest
from oracle import by_duckdb, by_spark
from slotforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    assert by_spark(spark, sf, queries.QUERIES[name]) == by_duckdb(sf, queries.ORACLE_SQL[name])
