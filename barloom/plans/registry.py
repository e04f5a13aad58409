"""Name -> query and name -> equivalent DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("bars", "quality", "state", "models", "news", "alerts", "universe", "stored", "reads", "backtest", "forecasters", "folds")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated (spark, sf_dir) -> DataFrame, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def registered_sql(name: str) -> str:
    """The SQL of a query of a module that is loaded already, to build on."""
    return _SQL[name]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
