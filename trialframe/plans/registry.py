"""The registered queries and, where plain SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialframe.plans.views import Views, sql_with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; ``sql`` may use the shared view names."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql_with_views(sql)
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """Rounded value in oracle text, without negative zero."""
    return f"(CAST(round(CAST({expr} AS DOUBLE), {digits}) AS DOUBLE) + CAST(0 AS DOUBLE))"
