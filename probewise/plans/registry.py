"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probewise.plans.sql_tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(
    name: str,
    sql: str | None = None,
    extra: dict[str, str] | None = None,
    recursive: bool = False,
    embed: bool = True,
):
    """Register a query; without ``sql`` only its rows are checked.

    The tables the SQL names are put before it unless ``embed`` is off.
    """

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_tables(sql, extra, recursive) if embed else sql
        return function

    return register
