"""Operator 5: exact dedup by progressive refinement.

Texts are grouped by length, then by a hash of their first characters, then
by a digest of the whole text. Each step hashes only the rows whose group of the step
before has at least two rows; the survivors are handed on as a bitmap of
fixed size, so no text is ever shuffled by ``exact_dedup`` and a group that
holds a third of all rows is combined map-side by its aggregates.

Defined cases: null text counts as empty, and all empty texts are equal;
rows that repeat an id with the same text are one group, of which one row is
kept; a null id sorts below every id; an empty table gives an empty result;
other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import BITS, key_bitmap, mark_members, materialize, text_of

PREFIX_CHARS = 64


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def refine(base: DataFrame, prefix_chars: int = PREFIX_CHARS, bits: int = BITS) -> DataFrame:
    """Adds ``_len``, ``_prefix`` and ``_full`` to rows with a ``_text``.
    ``_prefix`` is null where the length is unique, ``_full`` (SHA-256) where
    the length and prefix are: such rows have no equal."""
    sized = base.withColumn("_len", F.octet_length("_text"))
    lengths = key_bitmap(_repeated(sized.select("_len"), "_len"), "_len", bits=bits)
    second = mark_members(sized, lengths, "_len", name="_hit", bits=bits) \
        .withColumn("_prefix", F.when(F.col("_hit"), F.xxhash64(F.substring("_text", 1, prefix_chars)))).drop("_hit")
    pairs = _repeated(second.filter(F.col("_prefix").isNotNull()).select("_len", "_prefix"), "_len", "_prefix")
    return mark_members(second, key_bitmap(pairs, "_len", "_prefix", bits=bits), "_len", "_prefix", name="_hit", bits=bits) \
        .withColumn("_full", F.when(F.col("_hit") & F.col("_prefix").isNotNull(), F.sha2("_text", 256))).drop("_hit")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                prefix_chars: int = PREFIX_CHARS, bits: int = BITS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id (largest id of its group),
    group_size (rows), kept; with ``digest`` also text_sha256 of every text."""
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    extra = [F.sha2("_text", 256).alias("text_sha256")] if digest else []
    rows = materialize(refine(base, prefix_chars, bits)
                       .select("_id", "_len", "_prefix", "_full", F.monotonically_increasing_id().alias("_uid"), *extra))
    keys = ["_len", "_prefix", "_full"]
    groups = (rows.filter(F.col("_full").isNotNull()).groupBy(*keys)
                  .agg(F.max(F.struct("_id", "_uid")).alias("_keep"), F.count(F.lit(1)).alias("_size")))
    return rows.join(groups, keys, "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_keep").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_uid") == F.col("_keep._uid"), F.lit(True)).alias("kept"),
        *(["text_sha256"] if digest else []))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, bits: int = BITS) -> DataFrame:
    """``docs`` with one row (the largest id) of each group of equal texts, all columns
    kept. Rows without an equal pass through without a shuffle; of the others
    a partition ships one row per group."""
    cols = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    base = docs.select(whole.alias("_row"), F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"),
                       F.xxhash64(*[F.col(f"`{c}`") for c in cols]).alias("_tie"))
    marked = refine(base, prefix_chars, bits).drop("_text")
    keys = ["_len", "_prefix", "_full"]
    single = marked.filter(F.col("_full").isNull()).select("_row")
    winner = (marked.filter(F.col("_full").isNotNull()).groupBy(*keys)
                    .agg(F.max_by("_row", F.struct("_id", "_tie")).alias("_row")).select("_row"))
    return single.unionByName(winner).select("_row.*")
