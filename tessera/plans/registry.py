"""Query registry: name -> (spark builder, DuckDB oracle SQL or None).

Each registered query reads the driver tables (through the record views)
and runs one operator over the whole tables. ``__spark_entry__`` exposes
the registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import views as V
from ..sources.tables import Tables
from .oracle_views import with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)


__all__ = ["QUERIES", "register", "tables", "V", "with_views"]
