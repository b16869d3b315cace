"""Shared building blocks: per-group top-k (W1), latest per key (W2), written
intermediates and look-up sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _cols(xs) -> list:
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def materialize(df: DataFrame) -> DataFrame:
    """Evaluates ``df`` once and cuts its lineage: the rows are written as a
    Parquet table under the shared ``spark.checkpoint.dir`` and read back.
    For an intermediate read by several consumers; a lost executor re-reads
    the table instead of recomputing the plan."""
    import uuid

    from ..session import shared_path

    path = shared_path(df.sparkSession, f"materialized-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """A side meant for look-ups, written once so that Spark knows its size in
    bytes: the planner broadcasts it when that is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise (AQE
    splits skewed partitions). Rows held by the plan itself stay as they are.
    No hint is given, so nothing is broadcast beyond the session's bound."""
    return df if df.isLocal() else materialize(df)


def top_k_per(df: DataFrame, by, order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per group under a total order.

    ``row_number() <= k`` is planned as a WindowGroupLimit: every map task
    keeps at most k rows per group before the shuffle, so even a group that
    holds a third of all rows ships only k rows per partition.
    """
    w = Window.partitionBy(*_cols(by)).orderBy(*order)
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out.withColumn(name, F.col(name).cast("long")) if rank_col else out.drop(name)


def number_rows(df: DataFrame, keys, order: Sequence[Column], bucket: Column, name: str = "i") -> DataFrame:
    """``row_number()`` over (keys, order) in two levels, so a key holding a
    third of all rows is numbered by many tasks: rows are numbered inside
    (keys, ``bucket``) only; the bucket sizes (one row per key and bucket)
    give each bucket's offset by a running sum; number = offset + local
    number. ``bucket`` must not decrease along ``order`` (e.g. the day of
    the leading time column)."""
    keys = _cols(keys)
    b = df.withColumn("_bk", bucket)
    b = b.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bk").orderBy(*order)))
    sizes = b.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return b.join(sizes, [*keys, "_bk"], "inner") \
        .withColumn(name, (F.col("_off") + F.col("_local")).cast("long")).drop("_bk", "_local", "_off")


def latest(df: DataFrame, key, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest row per key (ties broken by ``tie`` columns, descending).

    Written as a ``max_by`` over a struct: an aggregate with a map-side
    partial step (sort-based, as the buffer holds a struct), so a hot key is
    combined before the shuffle."""
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), *[F.col(t) for t in tie])
    return (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), order).alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))
