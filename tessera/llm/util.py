"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import materialize  # noqa: F401 - re-exported
from ..sources.tables import table  # noqa: F401 - re-exported


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id written as text, mod ``m`` (the folds of the contracts)."""
    return F.crc32(F.col(id_col).cast("string")) % m


def text_of(col: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, col: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into runs of rows holding about ``max_bytes`` of the
    text column (a longer single text is a run of its own), so the working
    memory of a Python task follows the run and not the batch."""
    arr = batch.column(batch.schema.get_field_index(col))
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def spark_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks, so
    what one operator's caches took would add to what the next needs."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A map over Arrow batches that gives its memory back when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


# ---- survivor filters ------------------------------------------------------
#
# A set of keys of any size as a bitmap of 2**bits slots: its size is fixed
# by ``bits`` (2**23 slots: 1 MB), so it may be broadcast whatever the number of keys.
# Slots are shared by colliding keys: the test may say yes for a key outside
# the set, never no for a key inside it. Exact joins follow.

BITS = 23


def key_bitmap(keys: DataFrame, *cols: str, bits: int = BITS) -> DataFrame:
    """(_bucket, _bitmap) rows, at most 2**bits / 32768 of 4 KB each."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    return (keys.select(slot.alias("_slot"))
                .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bitmap")))


def mark_members(df: DataFrame, bitmap: DataFrame, *cols: str, name: str, bits: int = BITS) -> DataFrame:
    """Adds boolean ``name``: false only for rows whose key is certainly not in the set."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    pos = F.bitmap_bit_position(F.col("_slot"))
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.lit([1 << i for i in range(8)]), (pos % 8 + 1).cast("int"))
    hit = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    return (df.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
              .join(F.broadcast(bitmap), "_bucket", "left")
              .withColumn(name, hit).drop("_slot", "_bucket", "_bitmap"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``. Rows that the bitmap
    of the ids rules out pass without a shuffle; only the others meet the
    exact anti join, so the texts of kept documents stay where they are."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(id_col).alias("_id"))
    packed = mark_members(packed, key_bitmap(ids.select(F.col(id_col).alias("_id")), "_id"), "_id", name="_hit")
    gone = ids.select(F.col(id_col).alias("_id")).distinct()
    kept = packed.filter(~F.col("_hit")).select("_row")
    tested = packed.filter("_hit").join(gone, packed["_id"].eqNullSafe(gone["_id"]), "left_anti").select("_row")
    return kept.unionByName(tested).select("_row.*")


def tokenizer_path(name: str) -> str:
    """Default place of a vocabulary file (a parameter of the operators)."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
