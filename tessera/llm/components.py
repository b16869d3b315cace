"""Connected components of a link table by alternating large-star and small-star
steps (joins and aggregates; neighbours are never collected). Each step's
links are written as a table, so a lost executor reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .util import materialize

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link to another, the smallest node it can reach.
    Links may repeat, point either way or to the node itself."""
    edges, before = _written(_oriented(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    for _ in range(MAX_ROUNDS):
        if before["n"]:
            edges, after = _written(_small_star(_large_star(edges)))
        if not before["n"] or after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
                .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, with their number and a sum of their hashes (taken while writing)."""
    state = Observation()
    table = materialize(edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return table, state.get


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _oriented(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return _oriented(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
