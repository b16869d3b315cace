"""Knowledge-base vector search: J7, K6, K10, K14, K15, K16, plus the probe
query set used by the registered queries.

Shape of the work: a small query table (one row per question, with its
tenant and vector) against a large chunk table. The query side is written
once, so Spark knows its bytes: under the session's broadcast threshold the
chunk table is scanned in place and never shuffled, whatever its tenant
skew; beyond it the join is a shuffle whose skewed partitions AQE splits.
Scoring is native (higher-order array functions, no Python). Per-query top-k
runs as a WindowGroupLimit, so each chunk partition ships at most k rows per
query to the final shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cosine, score4
from .common import lookup, top_k_per


# Probe queries ---------------------------------------------------------------
def probe_queries(chunks: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Two query vectors per tenant derived from its chunks: the element-wise
    maximum and minimum. Work is one pass over the chunks (partial
    aggregation per (tenant, position)); the collected arrays are bounded by
    the vector dimension."""
    e = chunks.select("tenant_id", F.posexplode(vec_col).alias("pos", "v"))
    per_pos = e.groupBy("tenant_id", "pos").agg(F.max("v").alias("mx"), F.min("v").alias("mn"))
    vecs = per_pos.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct("pos", "mx", "mn"))).alias("s"))
    mx = vecs.select(F.concat(F.lit("max-"), F.col("tenant_id").cast("string")).alias("query_id"), "tenant_id",
                     F.transform("s", lambda x: x["mx"]).alias("query_vec"))
    mn = vecs.select(F.concat(F.lit("min-"), F.col("tenant_id").cast("string")).alias("query_id"), "tenant_id",
                     F.transform("s", lambda x: x["mn"]).alias("query_vec"))
    return mx.unionByName(mn)


# J7 -----------------------------------------------------------------------
def score_pairs(queries: DataFrame, chunks: DataFrame, vec_col: str = "embedding",
                qvec_col: str = "query_vec", min_score: float | None = None) -> DataFrame:
    """The chunks of each query's tenant, scored with the reference's
    cosine (shorter length, zero norm gives 0) rounded to 4. ``min_score``
    keeps only pairs at or above it; without it the caller takes a top-k or
    an aggregate of the pairs, which are never written out."""
    j = chunks.join(lookup(queries), "tenant_id", "inner") \
        .withColumn("score", score4(cosine(F.col(qvec_col), F.col(vec_col))))
    return j if min_score is None else j.filter(F.col("score") >= F.lit(min_score))


# K10 ----------------------------------------------------------------------
def search(queries: DataFrame, chunks: DataFrame, k: int = 3, vec_col: str = "embedding",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Best k chunks per query inside its tenant, ranked by rounded score
    (desc) then chunk id; adds ``rank`` 1..k."""
    cols = ["query_id", "tenant_id", "chunk_id", *keep]
    pairs = score_pairs(queries, chunks.select("tenant_id", "chunk_id", vec_col, *keep), vec_col)
    return top_k_per(pairs.select(*cols, "score"), "query_id",
                     [F.col("score").desc(), F.col("chunk_id")], k, rank_col="rank")


# K14 ----------------------------------------------------------------------
def build_context(queries: DataFrame, hits: DataFrame, threshold: float = 0.0, sep: str = "\n---\n",
                  text_col: str = "content", title_col: str = "title") -> DataFrame:
    """Drop hits under ``threshold``, then one row per query with the
    number of matches, the context (numbered sources joined by ``sep``, in
    rank order) and the source titles. Queries without a match keep one row
    with ``matches = 0`` and an empty context. A hit whose text is NULL can't
    ground an answer: it is neither counted nor listed.

    ``hits`` holds at most k rows per query, so the per-query list is bounded."""
    h = hits.filter((F.col("score") >= F.lit(threshold)) & F.col(text_col).isNotNull())
    item = F.struct(F.col("rank"), F.col(text_col).alias("text"), F.col(title_col).alias("title"))
    g = h.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    numbered = F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    out = queries.select("query_id", "tenant_id").join(g, "query_id", "left")
    items = F.coalesce(F.col("items"), F.array())
    return out.select(
        "query_id", "tenant_id",
        F.when(F.size(items) > 0, F.lit("ok")).otherwise(F.lit("no_match")).alias("status"),
        F.size(items).alias("matches"),
        F.array_join(F.coalesce(numbered, F.array()), sep).alias("context"),
        F.transform(items, lambda x: x["title"]).alias("sources"))


# K6 -----------------------------------------------------------------------
def check_vectors(vecs: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """K6: adds ``problems`` (array of rule names) and ``vector_ok``:
    null vector, wrong dimension, null element, non-finite element, zero norm."""
    v = F.col(vec_col).cast("array<double>")
    rules = [
        ("null_vector", v.isNull()),
        ("wrong_dimension", v.isNotNull() & (F.size(v) != dim)),
        ("null_element", F.exists(v, lambda x: x.isNull())),
        ("not_finite", F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))),
        ("zero_norm", v.isNotNull() & F.forall(v, lambda x: F.coalesce(x, F.lit(0.0)) == 0)),
    ]
    probs = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]),
                     lambda x: x.isNotNull())
    return vecs.withColumn("problems", probs).withColumn("vector_ok", F.size("problems") == 0)


# K15 ----------------------------------------------------------------------
def _simhash_bands(vec: F.Column, planes: list[list[float]], bands: int) -> F.Column:
    """Per vector: ``bands`` band keys, each the sign bits of a group of
    random hyperplanes (cosine LSH). A pandas UDF: one matrix product per
    Arrow batch (vectors x hyperplanes) instead of one array expression per
    hyperplane and row."""
    p = np.asarray(planes, dtype=np.float64).T          # dim x (bands * bits)
    per = p.shape[1] // bands

    @F.pandas_udf("array<string>")
    def keys(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
        bits = (m @ p) >= 0
        out = []
        for row in bits:
            s = "".join("1" if b else "0" for b in row)
            out.append([f"{b}:{s[b * per:(b + 1) * per]}" for b in range(bands)])
        return pd.Series(out)

    return keys(vec)


def lsh_planes(dim: int, bands: int, bits: int, seed: int) -> list[list[float]]:
    """The ``bands * bits`` random hyperplanes (standard normal entries) of
    the LSH index, reproducible from ``seed``."""
    import random

    rnd = random.Random(seed)
    return [[rnd.gauss(0.0, 1.0) for _ in range(dim)] for _ in range(bands * bits)]


def approx_search(queries: DataFrame, chunks: DataFrame, k: int = 3, bands: int = 12, bits: int = 7,
                  seed: int = 7, vec_col: str = "embedding") -> DataFrame:
    """Approximate top-k. Chunks and queries get SimHash band keys
    (random hyperplanes from ``seed``); candidates are chunks of the query's
    tenant that share a band key with it; candidates are scored exactly and
    ranked as in K10. The chunk table is scanned in place when the queries are
    under Spark's broadcast threshold: no vector is copied or shuffled."""
    dim_row = chunks.select(F.size(vec_col).alias("d")).filter("d is not null").limit(1).collect()
    dim = dim_row[0]["d"] if dim_row else 0
    planes = lsh_planes(dim, bands, bits, seed)
    # Band keys stay an array on the row: a pair is a candidate if the arrays
    # overlap. Nothing is exploded, so no vector is copied or shuffled.
    cv = F.col(vec_col).cast("array<double>")
    ch = chunks.select("tenant_id", "chunk_id", vec_col, _simhash_bands(cv, planes, bands).alias("bands"))
    qv = F.col("query_vec").cast("array<double>")
    q = queries.select("query_id", "tenant_id", "query_vec", _simhash_bands(qv, planes, bands).alias("query_bands"))
    cand = ch.join(lookup(q), "tenant_id", "inner").filter(F.arrays_overlap("bands", "query_bands"))
    scored = cand.withColumn("score", score4(cosine(F.col("query_vec"), F.col(vec_col))))
    return top_k_per(scored.select("query_id", "tenant_id", "chunk_id", "score"), "query_id",
                     [F.col("score").desc(), F.col("chunk_id")], k, rank_col="rank")


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k found by the approximate search, per query."""
    a = approx.select("query_id", "chunk_id", F.lit(1).alias("found"))
    return (exact.join(a, ["query_id", "chunk_id"], "left")
            .groupBy("query_id")
            .agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall")))


# K16 ----------------------------------------------------------------------
def log_retrieval(turns: DataFrame, hits: DataFrame, used_threshold: float = 0.0) -> DataFrame:
    """Per turn, the retrieved chunks with scores (rank order), the best
    score, and whether context was used (best score at or over the threshold)
    or the turn should escalate. Turns without hits are kept."""
    h = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("citations"),
        F.max("score").alias("best_score"))
    out = turns.join(h, "query_id", "left")
    return out.select(
        *turns.columns,
        F.coalesce("citations", F.array()).alias("citations"),
        "best_score",
        F.coalesce(F.col("best_score") >= F.lit(used_threshold), F.lit(False)).alias("context_used"),
        (~F.coalesce(F.col("best_score") >= F.lit(used_threshold), F.lit(False))).alias("escalate"))
