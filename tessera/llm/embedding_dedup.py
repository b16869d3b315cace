"""Operator 6: embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label become one, with a count. The principal axes of all
vectors order the coordinates. Vectors are sorted by label and by the signs and value of their
leading coordinates and cut into blocks; pairs of blocks of a label whose boxes allow the threshold are compared by tiles. A tile pair accumulates the
leading coordinates first; the rest of every product is bounded by the
norms of the suffixes, rows and columns that cannot reach the threshold are left out, and the comparison stops when
none is left. What remains is decided on the original coordinates in double precision.

A tile adds the links of its vectors to their counts and hands on a
spanning forest of its links, at most one link per vector, so a group of near-equal vectors is never written out as
pairs. A label with a third of all vectors is many blocks, hence many tasks.

Defined cases: a vector that is null, zero, or holds a null or non-finite component, or whose label is null, links
with nothing and is its own component; vectors of different length never link; rows that repeat a vec_id with the same vector and label are copies
that link with each other; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import materialize

THRESHOLD = 0.93
BLOCK_BYTES = 2 << 20
TILE = 512
STEPS = (8, 16, 32)
SLACK = 1e-9             # for rounding in the bounds; decisions are exact
LEAD = 8                 # coordinates of a block's box


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes (columns) by falling variance of all unit vectors. Each task sums its
    outer products; Spark adds them up, so the driver sees dim x dim numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if len(x):
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        at = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(at[0] * dim + at[1], pa.int64()), pa.array(total[at])], ["at", "s"])

    got = (vectors.filter(F.size("_vec") == dim).select("_vec").mapInArrow(run, "at long, s double")
                  .groupBy("at").agg(F.sum("s").alias("s")).collect())
    cov = np.zeros((dim, dim))
    for r in got:
        cov[r["at"] // dim, r["at"] % dim] = cov[r["at"] % dim, r["at"] // dim] = r["s"]
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _forest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that join the rows and columns of a mask as all its links do: (row, column) pairs, one per
    row and column at most: each row to its first column, each column to its first row, and on from there."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    sub = mask[np.ix_(rows, cols)]
    label = np.arange(len(rows) + len(cols))
    while True:
        big = np.iinfo(np.int64).max
        r = np.minimum(label[:len(rows)], np.where(sub, label[None, len(rows):], big).min(1, initial=big))
        c = np.minimum(label[len(rows):], np.where(sub, r[:, None], big).min(0, initial=big))
        new = np.concatenate([r, c])
        if (new == label).all():
            return rows, cols, label[:len(rows)], label[len(rows):]
        label = new


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the pairs with cosine >= threshold. ``px``, ``py``: the unit vectors along the axes."""
    dim = px.shape[1]
    rows, cols = np.arange(len(x)), np.arange(len(y))
    done = 0
    product = np.zeros((len(x), len(y)))
    for upto in (*[s for s in STEPS if s < dim], dim):
        product += px[rows, done:upto] @ py[cols, done:upto].T
        done = upto
        tail = np.linalg.norm(px[rows, done:], axis=1)[:, None] * np.linalg.norm(py[cols, done:], axis=1)
        may = product + tail >= threshold - SLACK
        keep_r, keep_c = may.any(1), may.any(0)
        if not keep_r.any():
            return np.zeros((len(x), len(y)), bool)
        if not (keep_r.all() and keep_c.all()):
            rows, cols, product = rows[keep_r], cols[keep_c], product[np.ix_(keep_r, keep_c)]
    a, b = x[rows], y[cols]
    cosine = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
    out = np.zeros((len(x), len(y)), bool)
    out[np.ix_(rows, cols)] = cosine >= threshold
    return out


def _blocks(vectors: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, dim, block, n, lo, hi, ids, counts, data): runs of vectors in (label, position) order."""
    label_type = vectors.schema["_label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_dim").to_numpy()
            code = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _matrix(batch.column("_vec").take(pa.array(at)), dim)
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[dim][:, :LEAD]
                for k in range(min(LEAD, p.shape[1])):
                    code[at] = code[at] * 2 + (p[:, k] > 0)
                code[at] = code[at] * 1024 + ((p[:, 0] + 1) * 511.5).astype(np.int64).clip(0, 1023)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "_code"])

    fields = f"_label {label_type}, _vec array<double>, _dim int, _node long, _count long"
    coded = vectors.mapInArrow(place, fields + ", _code long")
    ranged = coded.repartitionByRange("_label", "_dim", "_code", "_node").sortWithinPartitions("_label", "_dim", "_code", "_node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, n = None, 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            dim = key[1]
            x = _matrix(t.column("_vec").chunk(0), dim)
            p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[dim][:, :LEAD]
            arrays = [pa.array([key[0]], t.schema.field("_label").type), pa.array([dim], pa.int32()), pa.array([t.column("_node")[0].as_py()], pa.int64()),
                      pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]),
                      *[pa.array([t.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("_node", "_count")],
                      pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["label", "dim", "block", "lo", "hi", "ids", "counts", "data"])

        for batch in batches:
            labels, dims = batch.column("_label").to_pylist(), batch.column("_dim").to_pylist()
            start = 0
            for i in range(batch.num_rows + 1):
                k = (labels[i], dims[i]) if i < batch.num_rows else None
                full = key is not None and n + i - start >= max(1, BLOCK_BYTES // (8 * key[1]))
                if k == key and not full:
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                    n += i - start
                    start = i
                if k is None:
                    continue
                if held:
                    yield flush()
                held, n, key, start = [], 0, k, i
        if held:
            yield flush()

    return ranged.mapInArrow(cut, f"label {label_type}, dim int, block long, lo array<double>, hi array<double>, ids binary, counts binary, data binary")


def _compare(pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, links, other): per pair of blocks, how many vectors each vector links (``other`` null), and the forest's links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, same = row["dim"], row["block"] == row["block2"]
                ids, ids2 = (np.frombuffer(row[c], np.int64) for c in ("ids", "ids2"))
                n, n2 = (np.frombuffer(row[c], np.int64) for c in ("counts", "counts2"))
                x, y = (np.frombuffer(row[c], np.float64).reshape(-1, dim) for c in ("data", "data2"))
                px, py = ((m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes[dim] for m in (x, y))
                links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
                tied: list[tuple[np.ndarray, np.ndarray]] = []
                for i in range(0, len(ids), TILE):
                    for j in range(i if same else 0, len(ids2), TILE):
                        a, b = slice(i, i + TILE), slice(j, j + TILE)
                        mask = linked(x[a], y[b], px[a], py[b], threshold)
                        if same and i == j:
                            np.fill_diagonal(mask, False)
                            mask |= mask.T
                        if not mask.any():
                            continue
                        links[a] += mask @ n2[b]
                        if not (same and i == j):
                            links2[b] += mask.T @ n[a]
                        rows, cols, lr, lc = _forest(mask)
                        names = np.concatenate([ids[a][rows], ids2[b][cols]])
                        tied.append((names, names[np.concatenate([lr, lc])]))
                node = np.concatenate([ids, ids2])
                count = np.concatenate([links, links2])
                node, count = node[count > 0], count[count > 0]
                u, v = (np.concatenate(z) for z in zip(*tied)) if tied else (np.zeros(0, np.int64),) * 2
                uv = np.unique(np.stack([u, v], 1)[u != v], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node, uv[:, 0]])), pa.array(np.concatenate([count, np.zeros(len(uv), np.int64)])),
                     pa.array(np.concatenate([node, uv[:, 1]]), mask=np.arange(len(node) + len(uv)) < len(node))], ["node", "links", "other"])

    return pairs.mapInArrow(run, "node long, links long, other long")


def embedding_dedup(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").alias("_label"),
                             F.col(f"`{vec_col}`").cast("array<double>").alias("_vec"), F.monotonically_increasing_id().alias("_uid"))
    limit = F.lit(float("inf"))
    good = (F.col("_label").isNotNull() & F.col("_vec").isNotNull()
            & F.coalesce(F.forall("_vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)), F.lit(False))
            & F.coalesce(F.exists("_vec", lambda v: v != 0), F.lit(False)))
    # -0.0 and 0.0 are one value, so equal vectors get equal keys.
    rows = materialize(rows.withColumn("_good", good).withColumn("_vec", F.when(good, F.transform("_vec", lambda v: v + F.lit(0.0)))))
    distinct = materialize(rows.filter("_good").groupBy("_label", "_vec").agg(F.min("_uid").alias("_node"), F.count(F.lit(1)).alias("_count"))
                               .select("_label", "_vec", F.size("_vec").alias("_dim"), "_node", "_count"))
    dims = [r["_dim"] for r in distinct.select("_dim").distinct().collect()]
    axes = {d: principal_axes(distinct, d) for d in dims}
    blocks = materialize(_blocks(distinct, axes))
    box = blocks.select("label", "dim", "block", "lo", "hi")
    other = box.select("label", "dim", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # Unit vectors with cosine >= t lie within sqrt(2 - 2t); so must their boxes.
    gap = F.aggregate(F.arrays_zip("lo", "hi", "lo2", "hi2"), F.lit(0.0),
                      lambda s, z: s + F.pow(F.greatest(z["lo"] - z["hi2"], z["lo2"] - z["hi"], F.lit(0.0)), F.lit(2)))
    near = box.join(other, ["label", "dim"]).filter((F.col("block") <= F.col("block2")) & (gap <= 2 - 2 * threshold + SLACK)) \
        .select("label", "dim", "block", "block2")
    keys = ["label", "dim", "block"]
    second = blocks.select("label", "dim", F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("data").alias("data2"))
    pairs = near.join(blocks.select(*keys, "ids", "counts", "data"), keys).join(second, ["label", "dim", "block2"])
    found = materialize(_compare(pairs.select("dim", "block", "block2", "ids", "counts", "data", "ids2", "counts2", "data2"), axes, threshold))
    links = found.filter(F.col("other").isNull()).groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("_links"))
    joined = components(found.filter(F.col("other").isNotNull()), "node", "other").select(F.col("node").alias("_node"), F.col("component").alias("_root"))
    # Each row's own vector, then the smallest id of each component.
    named = rows.join(distinct.select("_label", "_vec", "_node", "_count"), ["_label", "_vec"], "left").select("_id", "_uid", "_node", "_count")
    named = materialize(named.join(links, "_node", "left").join(joined, "_node", "left").select(
        "_id", (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("_count") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("_root", "_node", "_uid").alias("_root"), F.col("_node").isNull().alias("_alone")))
    least = named.groupBy("_root", "_alone").agg(F.min("_id").alias("_least"))
    return named.join(least, ["_root", "_alone"]).select(
        F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("_least").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_least"), F.lit(True)).alias("kept"))
