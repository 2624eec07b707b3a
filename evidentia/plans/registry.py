"""All queries by name; each module of queries adds its own with `query`."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from evidentia.session import ship

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("corpus", "search", "learning", "logs", "hybrid", "records", "streams")


class Registry:
    """Queries and their SQL, in the order in which they are written."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(f)
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return f(spark, folder)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return add


def _registries() -> list[Registry]:
    return [importlib.import_module(f"evidentia.plans.{m}").R for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
