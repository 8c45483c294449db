"""Named queries: a callable for Spark and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapline.fixtures import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register ``fn(tables)`` under a name; ``sql`` reads base tables and the named views."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            joined = sql.strip()
            if joined[:5].upper() == "WITH " and views:
                recursive = joined[5:].upper().startswith("RECURSIVE ")
                head = with_views("", *views).rstrip()
                head = head.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else head
                ORACLE_SQL[name] = f"{head},\n{joined[15 if recursive else 5 :]}"
            else:
                ORACLE_SQL[name] = with_views(joined, *views)
        return fn

    return add
