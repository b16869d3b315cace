"""Changes by partition (S9, S10, S11): a stored table loses or gets rows in place, and only
the folders that change are written.

Tables are Parquet folders partitioned by one column (``month=yyyy-MM`` or
``tenant_id=..``). Rows of changed partitions are written to the scratch folder first
and then put back by a dynamic partition overwrite, so every other file keeps its name; a
partition that loses all its rows loses its folder. A run that broke off is
simply run again. What comes to the driver is a list of partition values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ts_lit
from .common import lookup, materialize


def replace_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Writes ``rows`` in place of the partitions they belong to; others stay as they are. The
    ``rebalance`` hint gathers a partition into few files and splits a large one."""
    rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def replace_months(rows: DataFrame, path: str, ts_col: str) -> None:
    """S9, again for months that are there already: the months of ``rows`` are replaced."""
    replace_partitions(rows.withColumn("month", F.date_format(ts_col, "yyyy-MM")), path, "month")


def drop_partitions(spark: SparkSession, path: str, column: str, values: list) -> None:
    """Removes whole partitions by their folder; nothing is read."""
    for v in values:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={v}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _keep_rows(spark: SparkSession, path: str, column: str, rows: DataFrame, hit: list) -> list:
    """Leaves only ``rows`` in the partitions ``hit`` of the table."""
    if hit:
        kept = materialize(rows)
        left = {r[0] for r in kept.select(column).distinct().collect()}
        replace_partitions(kept, path, column)
        drop_partitions(spark, path, column, [v for v in hit if v not in left])
    return sorted(hit)


def purge_months(spark: SparkSession, path: str, policies: DataFrame, as_of: dt.datetime, ts_col: str,
                 days_col: str = "retention_days") -> list[str]:
    """S10 on a table by month: rows older than their tenant's retention at ``as_of`` go. Months from the latest
    cut-off on are never read; of the others only those that hold such a row are written.
    Returns these months."""
    cut = lookup(policies.filter(F.col(days_col).isNotNull()).select("tenant_id", F.timestamp_add("DAY", -F.col(days_col), ts_lit(as_of)).alias("_cut")))
    last = cut.agg(F.date_format(F.max("_cut"), "yyyy-MM")).first()[0]
    if last is None:
        return []
    table = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    old = table.withColumn("month", F.col("month").cast("string")).filter(F.col("month") <= last).join(cut, "tenant_id", "left")
    gone = F.coalesce(F.col(ts_col) < F.col("_cut"), F.lit(False))
    hit = [r[0] for r in old.filter(gone).select("month").distinct().collect()]
    return _keep_rows(spark, path, "month", old.filter(F.col("month").isin(hit) & ~gone).drop("_cut"), hit)


def delete_tenants(spark: SparkSession, paths: dict[str, str], tenants: list, references: list[tuple[str, str, str]] = ()) -> dict[str, list]:
    """S11 on tables by tenant: the tenants' folders go from every table of ``paths``, unread. ``references``
    (child, column, parent key's table) are set to NULL where they name a row that went; only the partitions of
    other tenants that hold such a row are written. Returns these by table."""
    gone = {}
    for child, column, parent in references:
        rows = spark.read.parquet(paths[parent]).filter(F.col("tenant_id").isin(tenants)).select(F.col(column).alias(column)).distinct()
        gone[(child, column, parent)] = materialize(rows)
    for path in paths.values():
        drop_partitions(spark, path, "tenant_id", tenants)
    written: dict[str, list] = {}
    for (child, column, _), keys in gone.items():
        table = spark.read.parquet(paths[child])
        marked = table.join(lookup(keys.withColumn("_gone", F.lit(True))), column, "left")
        hit = [r[0] for r in marked.filter("_gone").select("tenant_id").distinct().collect()]
        cleared = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(column)).cast(table.schema[column].dataType)
        rows = marked.filter(F.col("tenant_id").isin(hit)).withColumn(column, cleared).select(*table.columns)
        written.setdefault(child, []).extend(_keep_rows(spark, paths[child], "tenant_id", rows, hit))
    return written
