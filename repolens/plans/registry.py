"""Registry of named queries: Spark callables and their DuckDB oracle SQL.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame;
``ORACLE`` holds, for the same key, SQL over the driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if oracle is not None:
            ORACLE[name] = oracle()
        return fn
    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from repolens.plans import queries  # noqa: F401
