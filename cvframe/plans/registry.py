"""Query registry: every operator of the study as ``(spark, sf_dir) -> DataFrame``
plus, where SQL can state it, an independent DuckDB oracle string.

Each query reads the driver tables (or data Spark derives from them) in
full; nothing is sampled, capped or filtered by id to keep checks cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from cvframe.plans import queries  # noqa: F401
