"""Parquet table access.

Every read goes through ``spark.read.parquet`` so Catalyst can prune
columns and push filters into the scan; callers select what they need
and never ``cache`` whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, root).orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.root, name)
        raise AttributeError(name)
