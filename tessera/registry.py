"""All queries of the engine and their SQL, by name.

A query registers itself with its name and, where SQL can express it, the same in DuckDB's dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are named {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from .plans import checks, engines, manifests, models, motion, reports, samples, series, stores, streams, tables, windows  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
