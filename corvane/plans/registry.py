"""Where the plans' queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query over a folder of tables; sql says the same over views of those tables."""

    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return put
