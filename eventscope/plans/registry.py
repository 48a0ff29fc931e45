"""Registered queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventscope.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL over the fixture views where SQL can express it."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = with_views(sql)
        return function

    return add
