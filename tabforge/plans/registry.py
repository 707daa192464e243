"""Query registry: key → (Spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    fn: QueryFn
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, doc: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        if doc:
            fn.__doc__ = doc
        REGISTRY[key] = Query(key, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from tabforge.plans import (  # noqa: F401
        q_history,
        q_metrics,
        q_prep,
        q_profile,
        q_score,
        q_sources,
        q_split,
        q_train,
    )

    return REGISTRY
