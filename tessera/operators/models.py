"""Caller-supplied code and models over batches: E1, E2, K7, K8.

The work stays partitioned: ``mapInPandas`` hands each task its own
partition as Arrow batches of at most ``batch`` rows; the caller's function
sees a pandas frame and returns one. Nothing is collected or grouped, so
a skewed key cannot concentrate the model calls in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:                                       # \p{L}: the same letters as Spark's tokens
    import regex as _re
    _WORD = _re.compile(r"[\p{L}\p{N}]+")
except ImportError:                        # pragma: no cover
    import re as _re
    _WORD = _re.compile(r"[^\W_]+")

CACHE_WORDS = 60_000

Embedder = Callable[[list[str]], np.ndarray]


# E1 -----------------------------------------------------------------------
def apply_batch(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str | T.StructType,
                batch: int = 1000) -> DataFrame:
    """A caller's function over batches of rows (pandas in, pandas out)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                yield fn(pdf.iloc[i:i + batch].reset_index(drop=True))
    return df.mapInPandas(run, out_schema)


# E2 -----------------------------------------------------------------------
def apply_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], in_cols: list[str],
                out_schema: str, batch: int = 64, keep: list[str] | None = None) -> DataFrame:
    """A caller's model over batches of ``in_cols``; its output columns
    are appended. A batch whose call fails is retried row by row, and rows
    that still fail are kept with the error text in ``model_error`` (their
    output columns NULL)."""
    keep = keep or [c for c in df.columns]
    out_fields = (df.sparkSession.createDataFrame([], out_schema).schema if isinstance(out_schema, str)
                  else out_schema)
    schema = T.StructType([df.schema[c] for c in keep] + list(out_fields.fields) +
                          [T.StructField("model_error", T.StringType())])
    names = [f.name for f in out_fields.fields]

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            res = model(pdf[in_cols].reset_index(drop=True))
            res["model_error"] = None
            return res
        except Exception:  # noqa: BLE001 - retried per row below
            rows = []
            for i in range(len(pdf)):
                try:
                    r = model(pdf[in_cols].iloc[i:i + 1].reset_index(drop=True))
                    r["model_error"] = None
                except Exception as e:  # noqa: BLE001 - kept as data
                    r = pd.DataFrame({n: [None] for n in names})
                    r["model_error"] = f"{type(e).__name__}: {e}"
                rows.append(r)
            return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame(columns=names + ["model_error"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch].reset_index(drop=True)
                res = call(part)
                yield pd.concat([part[keep], res[names + ["model_error"]]], axis=1)
    return df.select(*sorted(set(keep + in_cols), key=(keep + in_cols).index)).mapInPandas(run, schema)


# K7 -----------------------------------------------------------------------
def embed(df: DataFrame, embedder: Embedder, text_col: str, model_name: str, model_version: str,
          dim: int, keep: list[str], batch: int = 128) -> DataFrame:
    """K7: batch embedding stage: the caller's embedder (list of texts ->
    2-D array) runs once per batch of ``batch`` texts; the vector, model name
    and version are written next to the kept columns."""
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch].reset_index(drop=True)
                vecs = np.asarray(embedder(part[text_col].fillna("").tolist()), dtype=np.float32)
                if vecs.shape != (len(part), dim):
                    raise ValueError(f"embedder returned {vecs.shape}, expected {(len(part), dim)}")
                out = part[keep].copy()
                out["embedding"] = list(vecs)
                out["model_name"] = model_name
                out["model_version"] = model_version
                yield out
    return df.select(*keep, text_col).mapInPandas(run, schema)


def words(text: str) -> list[str]:
    """Lower-cased letter/digit runs, as ``functions.expr.simple_tokens``."""
    return _WORD.findall(text.lower())


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in model (no network): signed feature hashing of
    the words (bucket from the first 8 hex digits of the word's MD5, sign from
    the 9th), L2-normalised; the same vectors as ``kb_text.hash_embed``. For
    tests and offline runs."""
    place: dict[str, int] = {}                # of words met before: bucket, and dim more for a minus

    def of(word: str) -> int:
        at = place.get(word)
        if at is None:
            if len(place) >= CACHE_WORDS:
                place.clear()
            h = hashlib.md5(word.encode("utf-8")).hexdigest()
            at = place[word] = int(h[:8], 16) % dim + (0 if int(h[8], 16) < 8 else dim)
        return at

    def fn(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for r, t in enumerate(texts):
            n = np.bincount(np.fromiter(map(of, words(t)), np.int64), minlength=2 * dim)
            out[r] = n[:dim] - n[dim:]
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        n[n == 0] = 1.0
        return out / n
    return fn


# K8 -----------------------------------------------------------------------
def reembed(chunks: DataFrame, embedder: Embedder, text_col: str, model_name: str, model_version: str,
            dim: int, keep: list[str], batch: int = 128) -> DataFrame:
    """K8: chunks whose ``model_version`` differs from the current one get new
    vectors (K7); the others are kept as they are. Returns the full set."""
    stale = chunks.filter(F.col("model_version").isNull() | (F.col("model_version") != model_version))
    fresh = chunks.filter(F.col("model_version") == model_version)
    redone = embed(stale, embedder, text_col, model_name, model_version, dim, keep, batch)
    return fresh.select(*keep, "embedding", "model_name", "model_version").unionByName(redone)
