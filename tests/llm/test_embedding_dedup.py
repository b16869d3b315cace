import math

import numpy as np
import pytest
from pyspark.sql import Row

from tessera.llm import embedding_dedup as E
from tessera.llm.components import components


def brute(rows, t=0.93):
    """n_links and component per (id, vector, label), by all pairs."""
    def ok(v, lab):
        return lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if ok(v, a) and ok(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, n[i], least[find(i)], d == least[find(i)]) for i, (d, _, _) in enumerate(rows))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(df).collect())


def test_table_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


@pytest.mark.parametrize("block", [2 << 20, 16 * 8 * 16])
def test_clusters_copies_and_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK_BYTES", block)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rnd.normal(scale=rnd.choice([0.05, 0.3]), size=16) if i % 7 else centres[0]
        rows.append((1000 - i, [float(x) for x in v], int(i % 3 == 0)))
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute(rows)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1),
            (8, [1.0, -0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [5.0, 0.1], 1), (12, [1.0, 0.0], 2), (12, [1.0, 0.0], 2)]
    df = spark.createDataFrame([Row(vec_id=a, embedding=b, label=c, n_links=0, _node=1) for a, b, c in rows],
                               "vec_id long, embedding array<float>, label int, n_links int, _node int")
    want = {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)} | {(7, 2, 7, True), (8, 2, 7, False), (11, 2, 7, False), (12, 1, 12, True)}
    assert set(got(df)) == want and len(got(df)) == 13
    assert E.embedding_dedup(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    rnd = np.random.default_rng(8)
    x, y = rnd.normal(size=(80, 64)), rnd.normal(size=(70, 64))
    y[:40] = x[:40] + rnd.normal(scale=0.35, size=(40, 64))
    axes = np.linalg.qr(rnd.normal(size=(64, 64)))[0]
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    assert (E.linked(x, y, u @ axes, v @ axes, 0.93) == (u @ v.T >= 0.93)).all()
    assert (u @ v.T >= 0.93).sum() > 5


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 10), (7, 7)] + [(i, i + 1) for i in range(100, 160)] + [(200 + i, 200) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 3 for k in (3, 4, 5, 9)}, 10: 10, 11: 10, **{i: 100 for i in range(100, 161)}, **{200 + i: 200 for i in range(50)}}
