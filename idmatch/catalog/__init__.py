"""Registered queries, each next to the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PARTS = ("vectorsets", "splits", "scores", "classification", "quality", "relations", "text", "series", "models", "files", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    for part in PARTS:
        import_module(f"{__name__}.{part}")
