"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("window_queries", "relational_queries", "metric_queries", "text_queries", "stream_queries", "estimator_queries", "panel_queries", "extra_queries", "inference_queries", "study_queries", "source_queries", "objective_queries", "portfolio_queries", "service_queries")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(spark, sf_dir) under ``name``; ``sql``: the same rows from DuckDB."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"panelspark.plans.{module}")
