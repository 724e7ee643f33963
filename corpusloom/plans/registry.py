"""Where query modules register what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with the SQL that must give the same rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
