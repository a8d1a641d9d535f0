"""Query registry: a Spark callable and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Tables
from . import oracle


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is completed with the named CTEs."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle.complete(sql, ctes) if sql else None)
        return fn
    return wrap


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, sf_dir: q.run(Tables(spark, sf_dir))
    return {name: bind(q) for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
