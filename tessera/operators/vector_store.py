"""Stored vectors (K7, K8, K13): a written table keyed by what was embedded, so a text is
embedded once for all documents, chunks, searches and re-indexings that hold it.

The table lies under ``path`` in folders by model name and version, one row per
content hash. ``refresh`` embeds the texts that have no vector there yet; a new
version of the model finds none and embeds all (K8), and the old vectors stay
until their folder is removed. One writer at a time, as with any Parquet
folder; a failed write leaves no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SCHEMA = "content_key string, embedding array<double>, model string, version string"
Embed = Callable[[DataFrame], DataFrame]        # (content_key, content) -> (content_key, embedding)


def key_of(text: str | Column) -> Column:
    """SHA-256 of the text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_vectors(spark: SparkSession, path: str, model: str, version: str) -> DataFrame:
    """(content_key, embedding) of one model version; empty where nothing is stored."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA).select("content_key", "embedding")
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.filter((F.col("model") == model) & (F.col("version") == version)).select("content_key", "embedding")


def missing(texts: DataFrame, path: str, model: str, version: str, text_col: str = "content") -> DataFrame:
    """(content_key, content) of the distinct texts without a stored vector. Keys are compared
    first; texts are combined per key in their own tasks."""
    keyed = texts.select(key_of(text_col).alias("content_key"), F.coalesce(text_col, F.lit("")).alias("content"))
    new = keyed.join(read_vectors(texts.sparkSession, path, model, version).select("content_key"), "content_key", "left_anti")
    return new.groupBy("content_key").agg(F.max("content").alias("content"))


def refresh(texts: DataFrame, path: str, embed: Embed, model: str, version: str, text_col: str = "content") -> DataFrame:
    """Embeds the texts that have no vector under ``path`` and adds these; returns all vectors of the model version."""
    new = materialize(missing(texts, path, model, version, text_col))
    vecs = embed(new).select("content_key", F.col("embedding").cast("array<double>").alias("embedding"),
                             F.lit(model).alias("model"), F.lit(version).alias("version"))
    if not new.isEmpty():
        vecs.write.mode("append").partitionBy("model", "version").parquet(path)
    return read_vectors(texts.sparkSession, path, model, version)


def with_vectors(rows: DataFrame, vectors: DataFrame, text_col: str = "content", vec_col: str = "embedding") -> DataFrame:
    """``rows`` with the stored vector of their text; the text itself does not travel through the join
    unless it is among the columns of ``rows``."""
    keyed = rows.withColumn("content_key", key_of(text_col)).drop(text_col)
    return keyed.join(vectors.withColumnRenamed("embedding", vec_col), "content_key", "left").drop("content_key")


def hash_embedder(dim: int = 64) -> Embed:
    """The offline stand-in model (``kb_text.hash_embed``) as an embedder."""
    from .kb_text import hash_embed
    return lambda rows: hash_embed(rows, ["content_key"], "content", dim)
