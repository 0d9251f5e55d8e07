"""Queries by name and the SQL that holds them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenfold.catalog import Tables

#: Modules of queries; importing one registers what it defines.
SUITES = ("scans", "joins", "aggregates", "windows", "text", "ranking", "graph", "code", "lifecycle", "evaluation")


@dataclass(frozen=True)
class Registered:
    name: str
    operators: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


_found: dict[str, Registered] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a query: the ids of the operators it covers, and its SQL if SQL can say it."""

    def add(build: Callable[[Tables], DataFrame]):
        assert name not in _found, name
        _found[name] = Registered(name, tuple(operators.split()), build, sql)
        return build

    return add


def _load() -> dict[str, Registered]:
    for name in SUITES:
        importlib.import_module(f"lumenfold.suite.{name}")
    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_load())


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in _load().items() if v.sql}
