"""Ranks inside groups of any size: one range partitioning, no window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

_ROWS_BITS = 33        # monotonically_increasing_id: the partition above, the row's place in it below


def order_key(name: str) -> Column:
    """A column as a string that is never null and sorts null first, else as its UTF-8 bytes."""
    return F.when(F.col(name).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(name).cast("string")))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` (0, 1, .. by ``order``, nulls first) and ``_n`` (rows) inside each ``group`` (never null).

    Rows are written, spread by ranges of (group, order) and sorted inside
    their partition, so a group with a third of all rows is many tasks. A row's
    place in its partition and the sizes of the group's parts (one row per
    group and partition that holds it) give its rank. Equal rows are told
    apart by their place in the written table, so they may be any number."""
    salted = materialize(rows).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    placed = materialize(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                         .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _ROWS_BITS))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.sum("_m").over(whole).alias("_n"),
                         (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(parts, [group, "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
