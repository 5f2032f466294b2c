"""Registered queries: each operator over the given tables, with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog import (  # noqa: F401  (importing registers the queries)
    cleaning,
    data_quality,
    feature_queries,
    fraud_queries,
    joins_windows,
    learning,
    scalar_queries,
    source_queries,
)
from catalog.base import REGISTRY

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}
