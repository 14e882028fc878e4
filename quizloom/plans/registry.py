"""Every query of the library outside llm, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when imported.
MODULES = ["marks", "bank", "texts", "match", "repeats", "etl", "store", "live", "checks"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the function's name, with the SQL that an oracle runs over the same tables."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql.strip()
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quizloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
