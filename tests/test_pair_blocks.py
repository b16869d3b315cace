"""Searches in cells of bounded size, and maps that work on parts of a batch."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import batches as B
from tessera.operators import kb_search as S
from tessera.operators import kb_text as K
from tessera.operators import models as M
from tessera.operators import pair_blocks as PB
from tessera.operators import passages as P

DOCS = "doc_id long, tenant_id int, content string"
Q = "query_id long, tenant_id int, query_text string"


@pytest.fixture
def tiny(monkeypatch):
    """Cells of a few rows, so that tenants are many cells."""
    monkeypatch.setattr(K, "POSTINGS", 7)
    monkeypatch.setattr(K, "VECTORS", 3)
    monkeypatch.setattr(PB, "QUESTIONS", 2)


def words(rnd, n):
    return " ".join(rnd.choice("ab bc cd de ef fg gh".split()) for _ in range(n))


def bm25(query, docs, k):
    """(score, id) of the best, by the formula; a repeated id is one document."""
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    total = {}
    for term in dict.fromkeys(query.split()):
        df = sum(term in t.split() for _, t in docs)
        for i, t in docs:
            tf, dl = t.split().count(term), len(t.split())
            if tf:
                w = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
                total[i] = total.get(i, 0) + w
    return sorted((-round(s, 6), i) for i, s in total.items())[:k]


def test_keyword_search_in_cells(spark, tiny):
    rnd = random.Random(1)
    docs = [(i, i % 2, words(rnd, rnd.randint(1, 9))) for i in range(40)] + [(3, 1, "ab bc"), (5, 1, "zz")]
    asked = [(i, i % 2, words(rnd, 3)) for i in range(9)] + [(9, None, "ab"), (10, 7, "ab"), (11, 1, None)]
    got = K.keyword_search(spark.createDataFrame(asked, Q), spark.createDataFrame(docs, DOCS), 4).collect()
    for q, t, text in asked:
        want = bm25(text, [(i, x) for i, tt, x in docs if tt == t], 4) if text and t in (0, 1) else []
        mine = [(-r.score, r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [i for _, i in mine] == [i for _, i in want]
        assert np.allclose([s for s, _ in mine], [s for s, _ in want], atol=2e-6)


def test_passages_in_cells_equal_one_cell(spark, monkeypatch):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, 1, words(rnd, 300)) for i in range(8)], DOCS)
    asked = spark.createDataFrame([(i, 1, words(rnd, 2)) for i in range(5)], Q)
    one = sorted(P.search_passages(asked, docs, 3).collect())
    monkeypatch.setattr(K, "POSTINGS", 5)
    monkeypatch.setattr(PB, "QUESTIONS", 2)
    assert sorted(P.search_passages(asked, docs, 3).collect()) == one and len(one) == 15


def test_vectors_in_cells_equal_the_native_search(spark, tiny):
    rnd = random.Random(3)
    vec = lambda: [float(rnd.randint(-2, 2)) for _ in range(4)]
    items = [(i, i % 2, vec()) for i in range(40)] + [(90, 0, None), (91, 0, [1.0, None, 0.0, 1.0]), (92, 1, [0.0] * 4), (7, 1, vec())]
    asked = [(f"q{i}", i % 2, vec()) for i in range(9)] + [("zero", 0, [0.0] * 4), ("null", 1, None), ("none", None, vec())]
    ch = spark.createDataFrame(items, "chunk_id long, tenant_id int, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id string, tenant_id int, query_vec array<double>")
    for k in (1, 5, 30):
        want = sorted(S.search(q, ch, k).select("query_id", "rank", "chunk_id", "score").collect(), key=str)
        got = sorted(K.best_by_cosine(q, ch, k, "chunk_id", ("chunk_id",)).select("query_id", "rank", "chunk_id", "score").collect(), key=str)
        assert got == want


def test_rounding_is_that_of_spark(spark):
    x = [0.03125, 0.00005, -0.00015, 0.12345, 0.12344999999999999, 1 / 3, -0.00001, 0.5]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 4) + F.lit(0.0)).collect()]
    assert PB.half_up(np.array(x), 4).tolist() == want


def test_chunks_travel_without_their_text(spark):
    docs = spark.createDataFrame([(1, 1, "a " * 2000)], DOCS)
    hits = spark.createDataFrame([(1, 1, 2)], "query_id long, doc_id long, chunk_no int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.passage_texts(hits, docs, keep=())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.first().chunk == ("a " * 2000)[1360:2160]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "Join LeftSemi" in line and "chunk_no" in line]
    assert not joins                                   # a semi join stands below the cut, over whole texts


def test_parts_hold_a_bounded_size():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "d", "e", "f" * 9]), pa.array([[1], [], None, [2, 3], [4], []])], ["t", "l"])
    assert [p.num_rows for p in B.parts(batch, 0, size=4)] == [2, 1, 2, 1]
    assert [p.num_rows for p in B.parts(batch, 1, size=2)] == [3, 1, 2]
    assert pa.Table.from_batches(B.parts(batch, 0, size=4)).equals(pa.Table.from_batches([batch]))


def test_maps_in_parts_change_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, 1, words(rnd, rnd.randint(0, 30))) for i in range(20)] + [(20, 1, None)], DOCS).coalesce(1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<title>a &amp; b</title><p>"), "content", F.lit(" &lt;")).alias("html"))
    take = lambda: [sorted(x.collect(), key=str) for x in (K.build_postings(docs), K.hash_embed(docs, ["doc_id"], "content", 8),
                                                          K.chunk_documents_recursive(docs, 20, 5), K.extract_pages(pages))]
    whole = take()
    monkeypatch.setattr(K, "PART_TOKENS", 3)
    monkeypatch.setattr(K, "PART_BYTES", 11)
    assert take() == whole


def test_embedder_keeps_few_words(monkeypatch):
    texts = ["one two two three", "", "four ONE ñandú", "two"]
    want = M.hashing_embedder(16)(texts)
    monkeypatch.setattr(M, "CACHE_WORDS", 2)
    calls, md5 = [], M.hashlib.md5
    assert (M.hashing_embedder(16)(texts) == want).all()
    monkeypatch.setattr(M, "CACHE_WORDS", 100)
    monkeypatch.setattr(M.hashlib, "md5", lambda b: calls.append(b) or md5(b))
    M.hashing_embedder(16)(texts)
    assert len(calls) == 5                             # once per word


def seen_cells(monkeypatch):
    """The items and questions that searches deal into cells."""
    seen, dealt = [], K.by_cell
    monkeypatch.setattr(K, "by_cell", lambda *a, **b: seen.append((a[0], a[2])) or dealt(*a, **b))
    return seen


def test_an_item_travels_as_one_row(spark, monkeypatch):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, i % 2, words(rnd, 400)) for i in range(6)] + [(6, 0, ""), (7, 0, None), (8, 5, "ab")], DOCS)
    asked = spark.createDataFrame([(1, 0, "ab bc"), (2, 1, "cd")], Q)
    seen = seen_cells(monkeypatch)
    assert P.search_passages(asked, docs, 3).count() == 6
    assert seen[0][0].count() == P.passages(docs).filter("tenant_id < 2").count()     # not a row per term
    K.keyword_search(asked, docs, 3)
    assert seen[1][0].count() == 6


def test_hits_are_found_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, 1, "a " * 2000) for i in range(3)], DOCS)
    hits = spark.createDataFrame([(1, 1, 2), (2, 1, 0), (3, 2, 5), (4, 9, 0)], "query_id long, doc_id long, chunk_no int")
    out = P.passage_texts(hits.mapInArrow(run, hits.schema), docs, keep=()).collect()
    assert rows.value == 4 and sorted((r.query_id, r.chunk_no, len(r.chunk)) for r in out) == [(1, 2, 800), (2, 0, 800), (3, 5, 600)]


def test_questions_with_the_same_terms_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 1, "Parking costs seven"), (2, 1, "the menu has soup"), (3, 2, "parking")], DOCS)
    asked = [(1, 1, "parking costs"), (2, 1, "Costs: PARKING, costs ?!"), (3, 2, "parking costs"), (4, 1, " ?!"), (5, 1, None)]
    seen = seen_cells(monkeypatch)
    got = K.keyword_search(spark.createDataFrame(asked, Q), docs, 3).collect()
    assert seen[0][1].count() == 2
    assert sorted((r.query_id, r.doc_id) for r in got) == [(1, 1), (2, 1), (3, 3)] and len({r.score for r in got if r.doc_id == 1}) == 1


@pytest.mark.parametrize("dense, cells", [(0.0, 1 << 23), (0.0, 200), (0.1, 1 << 23), (2.0, 1 << 23)])
def test_sums_by_matrix_and_by_postings(spark, monkeypatch, dense, cells):
    monkeypatch.setattr(PB, "DENSE", dense)
    monkeypatch.setattr(PB, "DENSE_CELLS", cells)
    rnd = random.Random(6)
    docs = [(i, words(rnd, rnd.randint(1, 12)) + f" w{i % 9}") for i in range(70)]
    asked = [words(rnd, rnd.randint(1, 4)) + f" w{i} w{i}" for i in range(20)]
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    terms = sorted({t for q in asked for t in q.split()} & {t for _, d in docs for t in d.split()})
    left = pa.table({"doc_id": [i for i, _ in docs], "dl": [len(t.split()) for _, t in docs], "terms": [" ".join(dict.fromkeys(t.split())) for _, t in docs],
                     "tfs": [[t.split().count(x) for x in dict.fromkeys(t.split())] for _, t in docs]})
    right = pa.table({"tenant_id": [1] * 21, "_q": pa.array([*(b"%d" % i for i in range(20)), None], pa.binary()),
                      "_terms": [*(" ".join(sorted(set(q.split()))) for q in asked), " ".join(terms)],
                      "_df": pa.array([None] * 20 + [[sum(x in t.split() for _, t in docs) for x in terms]], pa.list_(pa.int64())),
                      "_n": pa.array([None] * 20 + [n], pa.int64()), "_avgdl": pa.array([None] * 20 + [avg], pa.float64())})
    for k, batch in ((1, 1 << 22), (4, 150), (100, 1 << 22)):
        got = PB.best_sums(left.take(pa.array(rnd.sample(range(70), 70))), right, ["doc_id"], k, batch=batch).to_pylist()
        for i, q in enumerate(asked):
            want = bm25(q, docs, k)
            mine = [(r["score"], r["doc_id"]) for r in got if r["_q"] == b"%d" % i]
            assert [d for _, d in mine] == [d for _, d in want] and np.allclose([-s for s, _ in mine], [s for s, _ in want], atol=2e-6)


def test_stored_postings_give_the_same_hits(spark):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(i % 25, 1, words(rnd, rnd.randint(0, 9))) for i in range(40)] + [(50, 1, None), (51, 2, "ab")], DOCS)
    asked = spark.createDataFrame([(i, 1, words(rnd, 3)) for i in range(5)], Q)
    take = lambda x: sorted(x.collect())
    extra = spark.createDataFrame([(1, 3, "ab bc", 1, 2)], "tenant_id int, doc_id long, term string, tf long, dl long")     # not a token
    assert take(K.keyword_search(asked, docs, 4)) == take(K.keyword_search(asked, None, 4, postings=K.build_postings(docs).unionByName(extra)))
    assert take(P.search_passages(asked, docs, 4)) == take(P.search_passages(asked, None, 4, postings=P.build_passage_postings(docs)))
