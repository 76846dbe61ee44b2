"""Registered queries: a name, a function of (spark, sf_dir), and the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
