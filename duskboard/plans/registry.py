"""Where queries are registered next to their SQL check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskboard.sources.views import Tables, check_sql

#: Parameters of the registered queries; the given events run through January 2024.
TODAY = dt.date(2024, 1, 15)
NOW = dt.datetime(2024, 1, 15, 21, 10)
NOW_EARLY = dt.datetime(2024, 1, 15, 6, 10)
LOCALE = "ca"
LIST = "film"

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query over :class:`Tables` and, where SQL can say it, its check."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = check_sql(sql)
        return fn

    return register


def _load() -> None:
    from duskboard.plans import (  # noqa: F401
        agendas, extraction, generators, joining, ordering, reading, reports, rows, scalars, writing,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
