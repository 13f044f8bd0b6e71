"""The table of queries: name, Spark callable, SQL text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "io_queries", "row_queries", "join_queries", "aggregate_queries", "ordered_queries",
    "scalar_queries", "stats_queries", "model_queries", "plan_queries",
)


def query(name: str, sql: str | None = None):
    """Register a query under its survey key, with SQL giving the same rows."""
    def register(function: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(function: Callable[[Tables], DataFrame]):
        return lambda spark, folder: function(Tables(spark, folder))

    return {name: bind(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
