"""Queries over the driver's tables, one for each operator, with DuckDB SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from slotforge.queries import ledger, metrics, sampling, slots, streaming, text  # noqa: E402, F401
