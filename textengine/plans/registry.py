"""Registry of queries and of the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Views that oracle SQL may name: name -> SQL, in order of dependence.
VIEWS: dict[str, str] = {}
MODULES = ("text", "vectors", "neighbours", "rows", "evaluation", "monitoring", "models", "streams")


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id and, where SQL can say it, its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def with_views(sql: str) -> str:
    """Put the views that a statement needs before it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(VIEWS[name])

    need(sql)
    views = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not views:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


def _load() -> None:
    for m in MODULES:
        import_module(f"textengine.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ag_01_per_class"](spark, sf_dir)
