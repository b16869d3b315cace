from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import simple_tokens

from tessera.operators import kb_search as S
from tessera.operators import kb_text as K


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, tenant_id int, embedding array<float>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, tenant_id int, query_vec array<float>")


def test_topk_ties_isolation_and_empty(spark):
    ch = chunks(spark, [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [1.0, 0.0]),
                        (5, 1, [0.0, 0.0])])
    q = queries(spark, [("a", 1, [1.0, 0.0]), ("b", 3, [1.0, 0.0])])
    hits = S.search(q, ch, 3).orderBy("query_id", "rank").collect()
    assert [(h.chunk_id, h.score, h.rank) for h in hits] == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
    assert all(h.query_id == "a" for h in hits)              # tenant 2's chunk never reaches tenant 1
    ctx = {r.query_id: r for r in S.build_context(q, hits_df(spark, hits), 0.5).collect()}
    assert ctx["a"].matches == 2 and ctx["a"].context == "[1] t1\n---\n[2] t2" and ctx["a"].sources == ["T1", "T2"]
    assert ctx["b"].matches == 0 and ctx["b"].context == "" and ctx["b"].status == "no_match"


def hits_df(spark, hits):
    rows = [(h.query_id, h.chunk_id, h.score, h.rank, f"t{h.chunk_id}", f"T{h.chunk_id}") for h in hits]
    return spark.createDataFrame(rows, "query_id string, chunk_id long, score double, rank int, content string, title string")


def test_search_is_permutation_invariant(spark):
    rows = [(i, 1, [float(i % 7), float(i % 3), 1.0]) for i in range(40)]
    q = queries(spark, [("a", 1, [1.0, 2.0, 0.5])])
    a = [tuple(r) for r in S.search(q, chunks(spark, rows), 5).orderBy("rank").collect()]
    b = [tuple(r) for r in S.search(q, chunks(spark, list(reversed(rows))).repartition(7), 5).orderBy("rank").collect()]
    assert a == b


def test_check_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])],
                               "id int, embedding array<double>")
    got = {r.id: r.problems for r in S.check_vectors(df, 2).collect()}
    assert got == {1: [], 2: ["zero_norm"], 3: ["wrong_dimension"], 4: ["null_vector"], 5: ["not_finite"]}


def test_approx_search_finds_exact_neighbours(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, 1, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    ch = chunks(spark, rows)
    q = queries(spark, [(f"q{i}", 1, rows[i][2]) for i in range(5)])
    exact = S.search(q, ch, 1)
    approx = S.approx_search(q, ch, 1, bands=8, bits=4)
    rec = S.recall_at_k(approx, exact).agg(F.avg("recall")).first()[0]
    assert rec == 1.0                                         # a vector always collides with itself


def test_bm25_prefers_matching_doc(spark):
    d = spark.createDataFrame([(1, 1, "visiting hours are ten to seven"), (2, 1, "the menu has soup"),
                               (3, 2, "visiting hours elsewhere")], "doc_id long, tenant_id int, content string")
    q = spark.createDataFrame([(1, 1, "When are visiting hours?")], "query_id long, tenant_id int, query_text string")
    hits = K.keyword_search(q, d, 3).collect()
    assert [h.doc_id for h in hits] == [1]                    # tenant 2's document is not searched


def test_rrf(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    k = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    got = [r.doc_id for r in K.hybrid_search(v, k, 3).orderBy("rank").collect()]
    assert got == [11, 10, 12]


def test_shuffled_search_equals_broadcast(spark):
    rows = [(i, i % 3, [float(i % 5), float(i % 7), 1.0]) for i in range(120)]
    ch = chunks(spark, rows)
    q = queries(spark, [(f"q{i}", i % 3, [1.0, float(i), 0.5]) for i in range(12)])
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    a = sorted(tuple(r) for r in S.search(q, ch, 4).collect())
    spark.conf.set(key, "-1")
    try:
        out = S.search(q, ch, 4)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()   # no hint is given
        b = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set(key, old)
    assert a == b and len(a) == 48


def test_keyword_search_gives_no_broadcast_hint(spark):
    d = spark.createDataFrame([(i, i % 2, f"word{i} common text") for i in range(20)], "doc_id long, tenant_id int, content string")
    q = spark.createDataFrame([(i, i % 2, "common word3") for i in range(4)], "query_id long, tenant_id int, query_text string")
    want = sorted(tuple(r) for r in K.keyword_search(q, d, 3).collect())
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        out = K.keyword_search(q, d, 3)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in out.collect()) == want and len(want) == 12
    finally:
        spark.conf.set(key, old)


def test_postings_by_hand(spark):
    d = spark.createDataFrame([(1, 5, "a b, A c"), (2, 5, None), (3, 6, "b")], "doc_id long, tenant_id int, content string")
    got = {(r.tenant_id, r.doc_id, r.term, r.tf, r.dl) for r in K.build_postings(d).collect()}
    assert got == {(5, 1, None, 0, 4), (5, 1, "a", 2, 4), (5, 1, "b", 1, 4), (5, 1, "c", 1, 4), (5, 2, None, 0, 0), (6, 3, None, 0, 1), (6, 3, "b", 1, 1)}


def test_context_leaves_out_hits_without_text(spark):
    q = spark.createDataFrame([(1, 1)], "query_id long, tenant_id int")
    h = spark.createDataFrame([(1, 1, 0.9, None, "t1"), (1, 2, 0.8, "x", "t2")], "query_id long, rank int, score double, content string, title string")
    r = S.build_context(q, h).first()
    assert (r.matches, r.context, r.sources) == (1, "[1] x", ["t2"])


def test_model_errors_are_kept(spark):
    import pandas as pd

    from tessera.operators import models as M

    def model(pdf):
        if (pdf["t"] == "bad").any():
            raise ValueError("cannot score")
        return pd.DataFrame({"n": pdf["t"].str.len()})

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "id long, t string").coalesce(1)
    got = {r.id: (r.n, r.model_error) for r in M.apply_model(df, model, ["t"], "n long", batch=10, keep=["id"]).collect()}
    assert got == {1: (2, None), 2: (None, "ValueError: cannot score"), 3: (4, None)}


def hash_embed_shuffle(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 64) -> DataFrame:
    """``hash_embed`` with built-in functions only (explode, aggregate per
    (row, bucket), then per row): same result, two shuffles."""
    tok = df.select(*id_cols, F.explode_outer(simple_tokens(text_col)).alias("tok"))
    h = F.md5(F.col("tok"))
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, F.lit(1)).otherwise(F.lit(-1))
    per = (tok.filter(F.col("tok").isNotNull())
              .groupBy(*id_cols, bucket.alias("bucket")).agg(F.sum(sign).alias("v")))
    m = per.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0)).cast("double"))
    vec = df.select(*id_cols).join(m, id_cols, "left").select(*id_cols, dense.alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return vec.select(*id_cols, F.when(norm > 0, F.transform("raw", lambda x: x / norm))
                      .otherwise(F.col("raw")).alias("embedding"))


def test_hash_embedding_forms_agree(spark):
    """The map-only Arrow embedding, the shuffle form and the stand-in model
    give the same vectors."""
    import numpy as np

    from tessera.operators import models as M
    texts = ["Héllo wörld, héllo!", "", "one two three two", "42 is 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    a = {r.id: r.embedding for r in K.hash_embed(df, ["id"], "t", 16).collect()}
    b = {r.id: r.embedding for r in hash_embed_shuffle(df, ["id"], "t", 16).collect()}
    c = M.hashing_embedder(16)(texts)
    assert a == b
    for i in range(len(texts)):
        assert np.allclose(a[i], c[i])
    assert a[1] == [0.0] * 16
