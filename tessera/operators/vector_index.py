"""A stored candidate index for vector search (coarse quantiser).

Cells are fitted on a bounded sample: the ``SAMPLE`` vectors whose id has the lowest
MD5, a few rounds of k-means by cosine. Every vector of the table is assigned to
its nearest cell, in one map over Arrow batches, and the table is written in folders by
cell, so a search reads the folders of the cells it probes and no others.

A query probes every cell whose cosine is at least that of its nearest
cell less ``margin``. Vectors that form groups are found in a cell or
two; for vectors without any structure, where no index can tell the neighbours apart
beforehand, the margin takes in as many cells as the recall needs. Candidates
are scored exactly and ranked as in K10.

Vectors are compared as whole numbers (components scaled to +-127): sums are exact, so
cells do not depend on the order of rows or on the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cosine, score4
from .common import lookup, top_k_per

CELLS = 256
SAMPLE = 4096          # vectors that the cells are fitted on
ROUNDS = 4
MARGIN = 0.4
LEVELS = 127.0


@dataclass
class Cells:
    centres: np.ndarray            # cells x dimension, whole numbers

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def similarity(self, codes: np.ndarray) -> np.ndarray:
        """Dot product with every centre over the centre's norm; exact sums."""
        return codes @ self.centres.T / np.maximum(np.sqrt((self.centres ** 2).sum(1)), 1e-300)

    def nearest(self, codes: np.ndarray) -> np.ndarray:
        return self.similarity(codes).argmax(1) if len(self.centres) else np.zeros(len(codes), np.int64)

    def probes(self, codes: np.ndarray, margin: float) -> list[np.ndarray]:
        """Per query the cells whose cosine is within ``margin`` of the best."""
        if not len(self.centres):
            return [np.zeros(1, np.int64) for _ in codes]
        norm = np.sqrt((codes ** 2).sum(1, keepdims=True))
        cos = self.similarity(codes) / np.where(norm > 0, norm, 1.0)
        return [np.flatnonzero(row >= row.max() - margin) for row in cos]


def quantise(vectors: list, dim: int) -> np.ndarray:
    """Rows of whole numbers, the largest component of each +-127; shorter vectors
    are filled with zeros, longer ones cut, and components that are no number count as zero."""
    m = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None:
            a = np.array([np.nan if x is None else x for x in v[:dim]], dtype=np.float64)
            m[i, :len(a)] = np.where(np.isfinite(a), a, 0.0)
    top = np.abs(m).max(1, keepdims=True) if dim else np.ones((len(vectors), 1))
    return np.floor(m * LEVELS / np.where(top > 0, top, 1.0) + 0.5)


def fit_cells(chunks: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS,
              id_col: str = "chunk_id", vec_col: str = "embedding") -> Cells:
    """Cells of the table, from the ``sample`` vectors with the lowest MD5 of their id: at most
    ``sample`` vectors reach the driver. Only the lowest share of hashes is sorted, so
    no task meets more than a few times the sample."""
    rows = chunks.filter(F.size(vec_col) > 0).select(F.md5(F.col(id_col).cast("string")).alias("_h"), F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    n = rows.count()
    share = min(1.0, 3.0 * sample / n) if n else 1.0
    picked: list = []
    while n and len(picked) < min(sample, n):
        low = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32)))
        picked = (rows if share >= 1 else rows.filter(low)).orderBy("_h", "_id").limit(sample).select("_v").collect()
        if share >= 1:
            break
        share = min(1.0, share * 8)
    dim = max((len(r[0]) for r in picked), default=0)
    codes = quantise([r[0] for r in picked], dim)
    model = Cells(codes[:cells].copy())
    for _ in range(rounds):
        at = model.nearest(codes)
        sums = np.zeros_like(model.centres)
        np.add.at(sums, at, codes)
        filled = np.bincount(at, minlength=len(sums)) > 0
        model = Cells(np.where(filled[:, None], sums, model.centres))
    return model


def assign_cells(chunks: DataFrame, model: Cells, vec_col: str = "embedding") -> DataFrame:
    """``chunks`` with ``cell``, the nearest one; rows without a vector are left out, as no search finds them."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    at = chunks.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            cell = m.nearest(quantise(batch.column(at).to_pylist(), m.dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    from pyspark.sql.types import IntegerType, StructField, StructType
    rows = chunks.filter(F.col(vec_col).isNotNull())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def write_index(chunks: DataFrame, model: Cells, path: str, vec_col: str = "embedding") -> DataFrame:
    """Writes every vector under ``path``, in folders by cell, and returns the index. Rows are dealt by
    cell and a part of the tenant's hash, so a large cell is several files and a small one is one."""
    width = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = assign_cells(chunks, model, vec_col)
    parts = max(1, -(-width // max(1, len(model.centres))))
    dealt = out.repartition(width, "cell", F.pmod(F.xxhash64(*[c for c in out.columns if c not in (vec_col, "cell")]), F.lit(parts)))
    dealt.sortWithinPartitions("cell", "tenant_id").write.mode("overwrite").partitionBy("cell").parquet(path)
    return read_index(chunks.sparkSession, path, out)


def read_index(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The written index; ``like`` gives the columns, also of an empty one."""
    return spark.read.schema(like.schema).parquet(path)


def probe_cells(queries: DataFrame, model: Cells, margin: float = MARGIN, qvec_col: str = "query_vec") -> DataFrame:
    """(query_id, tenant_id, cell): the cells each query looks into."""
    @F.pandas_udf("array<int>")
    def near(v):
        import pandas as pd
        return pd.Series([c.tolist() for c in model.probes(quantise(list(v), model.dim), margin)])

    return queries.select("query_id", "tenant_id", F.explode(near(F.col(qvec_col).cast("array<double>"))).alias("cell"))


def search_index(queries: DataFrame, index: DataFrame, model: Cells, k: int = 3, margin: float = MARGIN,
                 id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """Per query the best ``k`` of the vectors of its tenant in the cells it probes, scored exactly and
    ranked as in K10. The index is scanned in place when the queries are under Spark's
    broadcast threshold; the probed cells prune its folders."""
    cells = lookup(probe_cells(queries, model, margin))
    pairs = index.join(cells, ["tenant_id", "cell"])
    vecs = lookup(queries.select("query_id", "query_vec"))
    scored = pairs.join(vecs, "query_id").select("query_id", "tenant_id", id_col, score4(cosine("query_vec", vec_col)).alias("score"))
    return top_k_per(scored, "query_id", [F.col("score").desc(), F.col(id_col)], k, rank_col="rank")


def candidate_share(queries: DataFrame, index: DataFrame, model: Cells, margin: float = MARGIN) -> float:
    """Scored pairs over the pairs that an exact search scores."""
    sizes = index.groupBy("tenant_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    looked = probe_cells(queries, model, margin).join(sizes, ["tenant_id", "cell"]).agg(F.sum("n")).first()[0] or 0
    every = queries.join(sizes, "tenant_id").agg(F.sum("n")).first()[0] or 0
    return looked / every if every else 0.0
