"""Named queries of the library, each with the SQL that an independent engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ["text", "urls", "timing", "filters", "joins", "entities", "aggregates", "windows", "feed", "pages", "twins", "extras", "upkeep", "exports"]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql is None where SQL cannot express it."""

    def register(f: Query) -> Query:
        _FOUND[f.__name__] = f, sql
        return f

    return register


def _load() -> dict[str, tuple[Query, str | None]]:
    for name in _MODULES:
        import_module(f"noticelake.queries.{name}")
    return _FOUND


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
