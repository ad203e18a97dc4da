"""Registry of the named queries run by the driver, the tests and the bench.

``register(name, sql)`` ties a Spark builder ``(spark, sf_dir) -> DataFrame``
to its DuckDB oracle text (or None when the operator is not expressible in
SQL; the driver then checks rows only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from wardlens.plans import q_cohort, q_eval, q_features, q_flags, q_learn, q_runs, q_series  # noqa: F401
