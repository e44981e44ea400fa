"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Views that the SQL texts share, by name.
WITH: dict[str, str] = {}


def sql(text: str, *views: str) -> str:
    """``text`` behind the shared views that it names."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS MATERIALIZED ({WITH[v]})" for v in views) + " " + text if views else text


def query(text: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add
