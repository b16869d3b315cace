"""The stored vector index, with its default parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kb_search as S
from tessera.operators import vector_index as I
from tessera.operators.common import materialize
from tessera.sources import views as V
from tessera.sources.tables import Tables

CH = "chunk_id long, tenant_id int, embedding array<float>"
Q = "query_id string, tenant_id int, query_vec array<float>"


def built(spark, chunks, tmp_path):
    model = I.fit_cells(chunks)
    return model, I.write_index(chunks, model, str(tmp_path / "index"))


def measured(queries, chunks, index, model, k=3):
    found = I.search_index(queries, index, model, k)
    recall = S.recall_at_k(found, S.search(queries, chunks, k)).agg(F.avg("recall")).first()[0]
    return recall, I.candidate_share(queries, index, model)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_with_defaults_on_the_tables(spark, sf, tmp_path):
    chunks = V.chunks(Tables(spark, f"/root/testdata/{sf}"))
    model, index = built(spark, chunks, tmp_path)
    assert index.count() == chunks.count()                    # every row is indexed
    recall, share = measured(materialize(S.probe_queries(chunks)), chunks, index, model)
    assert recall >= 0.9 and share < 0.85                      # no structure at all in these vectors


def test_grouped_vectors_need_few_candidates(spark, tmp_path):
    rnd = np.random.default_rng(1)
    topics = rnd.normal(size=(40, 64))
    vecs = topics[rnd.integers(0, 40, 4000)] + 0.5 * rnd.normal(size=(4000, 64))
    chunks = spark.createDataFrame([(i, i % 10, v.tolist()) for i, v in enumerate(vecs)], CH)
    asked = spark.createDataFrame([(f"q{i}", i % 10, (vecs[i * 37] + 0.3 * rnd.normal(size=64)).tolist()) for i in range(60)], Q)
    model, index = built(spark, chunks, tmp_path)
    recall, share = measured(asked, chunks, index, model)
    assert recall >= 0.9 and share < 0.1


def test_cells_do_not_depend_on_order_or_partitions(spark):
    rnd = np.random.default_rng(2)
    chunks = spark.createDataFrame([(i, 0, rnd.normal(size=16).tolist()) for i in range(3000)], CH)
    a, b = I.fit_cells(chunks, sample=500), I.fit_cells(chunks.repartition(13).sort(F.desc("chunk_id")), sample=500)
    assert (a.centres == b.centres).all() and a.centres.shape == (I.CELLS, 16)


def test_a_search_reads_only_the_folders_it_probes(spark, tmp_path):
    rnd = np.random.default_rng(3)
    topics = 5 * rnd.normal(size=(8, 16))
    chunks = spark.createDataFrame([(i, 0, (topics[i % 8] + rnd.normal(size=16)).tolist()) for i in range(800)], CH)
    model, index = built(spark, chunks, tmp_path)
    asked = spark.createDataFrame([("q", 0, topics[3].tolist())], Q)
    cells = {r.cell for r in I.probe_cells(asked, model).collect()}
    part = index.filter(F.col("cell").isin(list(cells)))
    assert "PartitionFilters: [" in part._jdf.queryExecution().toString()
    files = [x.select(F.input_file_name().alias("f")).distinct().count() for x in (part, index)]
    assert 0 < files[0] < 0.6 * files[1]
    assert {r.chunk_id % 8 for r in I.search_index(asked, index, model).collect()} == {3}


def test_odd_vectors_ties_and_tenants(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 0.0]), (4, 2, [1.0, 0.0]), (5, 1, None), (6, 1, []),
                                    (7, 1, [float("nan"), 1.0]), (8, 1, [0.5]), (9, None, [1.0, 1.0])], CH)
    model, index = built(spark, chunks, tmp_path)
    assert index.count() == 8                                  # all but the row without a vector
    asked = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 3, [1.0, 0.0])], Q)
    got = [(r.query_id, r.chunk_id, r.rank) for r in I.search_index(asked, index, model, 2).sort("rank").collect()]
    assert len(got) == 2 and all(q == "a" and c in (1, 2, 7, 8) for q, c, _ in got)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], CH)
    model, index = built(spark, empty, tmp_path)
    assert index.count() == 0 and I.search_index(spark.createDataFrame([("a", 1, [1.0])], Q), index, model).count() == 0
