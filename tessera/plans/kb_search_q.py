"""Registered queries: vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kb_search as S
from ..operators import kb_text as K
from ..operators import passages as P
from ..operators import vector_index as I
from ..operators import vector_store as VS
from ..operators.common import materialize
from ..session import shared_path
from .kb_text_q import CHUNKS_SQL, hash_sql
from .registry import V, register, tables, with_views

CONTEXT_THRESHOLD = 0.25

# DuckDB forms of the probe queries and the reference cosine.
PROBES = {
    "pp": """SELECT tenant_id, i, max(v) AS mx, min(v) AS mn FROM (
               SELECT tenant_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM v_chunks)
             GROUP BY tenant_id, i""",
    "q": """SELECT 'max-' || CAST(tenant_id AS VARCHAR) AS query_id, tenant_id, list(mx ORDER BY i) AS query_vec
            FROM pp GROUP BY tenant_id
            UNION ALL
            SELECT 'min-' || CAST(tenant_id AS VARCHAR), tenant_id, list(mn ORDER BY i) FROM pp GROUP BY tenant_id""",
}
COS = """(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) /
  CASE WHEN sqrt(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])))
          * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) = 0 THEN 1
       ELSE sqrt(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])))
          * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) END)"""
HITS = dict(PROBES, **{
    "s": f"SELECT q.query_id, q.tenant_id, c.chunk_id, round({COS}, 4) + 0.0 AS score FROM q JOIN v_chunks c USING (tenant_id)",
    "h": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
            WHERE rank <= 3""",
})


def _search(spark, sf, k=3):
    ch = V.chunks(tables(spark, sf))
    return S.search(S.probe_queries(ch), ch, k)


register("k10_search", with_views("SELECT query_id, tenant_id, chunk_id, score, rank FROM h", "v_chunks",
                                  extra=HITS))(_search)


MIN_SCORE = 0.15


def _j7(spark, sf):
    ch = V.chunks(tables(spark, sf))
    return S.score_pairs(S.probe_queries(ch), ch, min_score=MIN_SCORE).select("query_id", "tenant_id", "chunk_id", "score")


register("j7_score_pairs", with_views(f"SELECT query_id, tenant_id, chunk_id, score FROM s WHERE score >= {MIN_SCORE}", "v_chunks",
                                      extra={k: HITS[k] for k in ("pp", "q", "s")}))(_j7)


def question_vectors(t) -> DataFrame:
    return K.hash_embed(V.eval_questions(t), ["query_id", "tenant_id"], "query_text", 64).withColumnRenamed("embedding", "query_vec")


def passage_hits(spark, t, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """The evaluation questions and, for each, the best chunks of its tenant's whole documents by their stored vectors."""
    chunks = P.passages(V.docs(t))
    store = shared_path(spark, f"vectors-{uuid.uuid4().hex}")
    vecs = VS.refresh(chunks, store, VS.hash_embedder(), "hash", "1", text_col="chunk")
    q = materialize(question_vectors(t))
    return q, P.search_passage_vectors(q, chunks, vecs, k)


def _k14(spark, sf):
    t = tables(spark, sf)
    q, hits = passage_hits(spark, t)
    texts = P.passage_texts(hits, V.docs(t)).withColumnRenamed("chunk", "content")
    ctx = S.build_context(q, texts, CONTEXT_THRESHOLD)
    return ctx.withColumn("sources", F.array_join("sources", "|"))


PASSAGES = dict({
    "ch": CHUNKS_SQL,
    "pas": "SELECT *, CAST(doc_id AS VARCHAR) || ':' || lpad(CAST(chunk_no AS VARCHAR), 8, '0') AS chunk_id FROM ch",
}, **hash_sql("pas", "chunk_id", "chunk"), **hash_sql("v_eval", "query_id", "query_text"))
PASSAGES["ps"] = f"""SELECT e.query_id, e.tenant_id, p.doc_id, p.chunk_no, p.chunk_id, p.chunk, round({COS}, 4) + 0.0 AS score
    FROM v_eval e JOIN (SELECT query_id, embedding AS query_vec FROM v_eval_v) q ON q.query_id = e.query_id
    JOIN pas p ON p.tenant_id = e.tenant_id JOIN pas_v c ON c.chunk_id = p.chunk_id"""
PASSAGES["ph"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ps) WHERE rank <= 3"""

register("k14_build_context", with_views(f"""
SELECT q.query_id, q.tenant_id,
  CASE WHEN count(f.chunk_id) > 0 THEN 'ok' ELSE 'no_match' END AS status,
  count(f.chunk_id) AS matches,
  coalesce(string_agg('[' || CAST(f.pos AS VARCHAR) || '] ' || f.chunk, chr(10) || '---' || chr(10) ORDER BY f.rank), '') AS context,
  coalesce(string_agg(f.title, '|' ORDER BY f.rank), '') AS sources
FROM v_eval q LEFT JOIN f ON f.query_id = q.query_id
GROUP BY q.query_id, q.tenant_id
""", "v_docs", "v_eval", extra=dict(PASSAGES, f=f"""SELECT h.*, d.title,
    row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS pos
  FROM ph h JOIN v_docs d ON d.doc_id = h.doc_id WHERE h.score >= {CONTEXT_THRESHOLD}""")))(_k14)


def _k6(spark, sf):
    # some vectors spoiled, one way after the other
    at, v = F.col("chunk_id") % 40, F.col("embedding").cast("array<double>")
    ch = V.chunks(tables(spark, sf)).withColumn("embedding", F.when(at == 1, F.lit(None)).when(at == 2, F.slice(v, 1, 63))
        .when(at == 3, F.transform(v, lambda x: x * 0)).when(at == 4, F.transform(v, lambda x, i: F.when(i > 0, x)))
        .when(at == 5, F.transform(v, lambda x, i: F.when(i == 9, F.lit(float("nan"))).otherwise(x))).otherwise(v))
    out = S.check_vectors(ch, 64)
    return out.select("chunk_id", "tenant_id", F.array_join("problems", ",").alias("problems"), "vector_ok")


register("k6_check_vectors", with_views("""
SELECT chunk_id, tenant_id, array_to_string(p, ',') AS problems, len(p) = 0 AS vector_ok FROM (
  SELECT chunk_id, tenant_id, list_filter([
    CASE WHEN embedding IS NULL THEN 'null_vector' END,
    CASE WHEN embedding IS NOT NULL AND len(embedding) <> 64 THEN 'wrong_dimension' END,
    CASE WHEN list_count(embedding) < len(embedding) THEN 'null_element' END,
    CASE WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' END,
    CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(x, 0) <> 0)) = 0 THEN 'zero_norm' END
  ], lambda x: x IS NOT NULL) AS p FROM spoiled)
""", "v_chunks", extra={"spoiled": """SELECT chunk_id, tenant_id, CASE chunk_id % 40 WHEN 1 THEN NULL WHEN 2 THEN v[1:63]
    WHEN 3 THEN list_transform(v, lambda x: x * 0) WHEN 4 THEN list_transform(v, lambda x, i: CASE WHEN i > 1 THEN x END)
    WHEN 5 THEN list_transform(v, lambda x, i: CASE WHEN i = 10 THEN 'nan'::DOUBLE ELSE x END) ELSE v END AS embedding
  FROM (SELECT chunk_id, tenant_id, CAST(embedding AS DOUBLE[]) AS v FROM v_chunks)"""}))(_k6)


def _k15(spark, sf):
    ch = V.chunks(tables(spark, sf))
    q = materialize(S.probe_queries(ch))
    model = I.fit_cells(ch)
    index = I.write_index(ch, model, shared_path(spark, f"vector-index-{uuid.uuid4().hex}"))
    approx = I.search_index(q, index, model, 3)
    return approx.join(S.recall_at_k(approx, S.search(q, ch, 3)), "query_id", "left")


def _index_sql(cells: int = I.CELLS, sample: int = I.SAMPLE, rounds: int = I.ROUNDS, margin: float = I.MARGIN) -> dict:
    """The same index in SQL: whole-number codes, cells from the same sample by the same rounds."""
    def code(v: str) -> str:
        top = f"list_max(list_transform({v}, lambda x: abs(x)))"
        return f"list_transform({v}, lambda x: floor(x * {I.LEVELS} / (CASE WHEN {top} > 0 THEN {top} ELSE 1 END) + 0.5))"

    near = "list_dot_product(s.code, c.centre) / greatest(sqrt(list_dot_product(c.centre, c.centre)), 1e-300)"
    ctes = {
        "codes": f"SELECT chunk_id, tenant_id, {code('v')} AS code FROM (SELECT chunk_id, tenant_id, CAST(embedding AS DOUBLE[]) AS v FROM v_chunks WHERE embedding IS NOT NULL)",
        "smp": f"SELECT * FROM codes WHERE len(code) > 0 ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id LIMIT {sample}",
        "c0": f"SELECT row_number() OVER (ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id) - 1 AS cell, code AS centre FROM smp QUALIFY cell < {cells}",
    }
    assigned = """SELECT * FROM (SELECT s.chunk_id, s.tenant_id, s.code, c.cell, row_number() OVER (PARTITION BY s.chunk_id ORDER BY {near} DESC, c.cell) AS o
                  FROM {rows} s, {centres} c) WHERE o = 1"""
    for r in range(rounds):
        ctes[f"a{r}"] = assigned.format(near=near, rows="smp", centres=f"c{r}")
        ctes[f"s{r}"] = f"""SELECT cell, list(x ORDER BY i) AS centre FROM (
            SELECT cell, i, sum(x) AS x FROM (SELECT cell, unnest(code) AS x, unnest(range(len(code))) AS i FROM a{r}) GROUP BY cell, i) GROUP BY cell"""
        ctes[f"c{r + 1}"] = f"SELECT c.cell, coalesce(s.centre, c.centre) AS centre FROM c{r} c LEFT JOIN s{r} s ON s.cell = c.cell"
    last = f"c{rounds}"
    ctes["idx"] = assigned.format(near=near, rows="codes", centres=last)
    ctes["qc"] = f"SELECT query_id, tenant_id, {code('v')} AS code FROM (SELECT query_id, tenant_id, CAST(query_vec AS DOUBLE[]) AS v FROM q)"
    ctes["sims"] = f"""SELECT s.query_id, s.tenant_id, c.cell,
        {near} / (CASE WHEN list_dot_product(s.code, s.code) > 0 THEN sqrt(list_dot_product(s.code, s.code)) ELSE 1 END) AS sim FROM qc s, {last} c"""
    ctes["probes"] = f"SELECT query_id, tenant_id, cell FROM (SELECT *, max(sim) OVER (PARTITION BY query_id) AS best FROM sims) WHERE sim >= best - {margin}"
    ctes["ascored"] = f"""SELECT q.query_id, q.tenant_id, c.chunk_id, round({COS}, 4) + 0.0 AS score
        FROM probes p JOIN idx ON idx.tenant_id = p.tenant_id AND idx.cell = p.cell JOIN q ON q.query_id = p.query_id JOIN v_chunks c ON c.chunk_id = idx.chunk_id"""
    ctes["ah"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ascored) WHERE rank <= 3"""
    ctes["rec"] = """SELECT h.query_id, avg(CASE WHEN a.chunk_id IS NULL THEN 0 ELSE 1 END) AS recall
        FROM h LEFT JOIN ah a ON a.query_id = h.query_id AND a.chunk_id = h.chunk_id GROUP BY h.query_id"""
    return ctes


register("k15_approx_search", with_views("""
SELECT a.query_id, a.tenant_id, a.chunk_id, a.score, a.rank, r.recall FROM ah a LEFT JOIN rec r ON r.query_id = a.query_id
""", "v_chunks", extra=dict(HITS, **_index_sql())))(_k15)


def caller_turns(t) -> DataFrame:
    """What callers said, each as a question to its tenant's documents."""
    return V.turns(t).filter(F.col("role") == "caller").select(
        (F.col("call_id") * 100 + F.col("turn_no")).alias("query_id"), "call_id", "turn_no", "tenant_id", F.col("content").alias("query_text"))


def _k16(spark, sf):
    t = tables(spark, sf)
    asked = caller_turns(t)
    vecs = K.hash_embed(asked, ["query_id", "tenant_id"], "query_text", 64).withColumnRenamed("embedding", "query_vec")
    chunks = P.passages(V.docs(t))
    store = VS.refresh(chunks, shared_path(spark, f"vectors-{uuid.uuid4().hex}"), VS.hash_embedder(), "hash", "1", text_col="chunk")
    hits = P.search_passage_vectors(materialize(vecs), chunks, store, 3)
    log = S.log_retrieval(asked.drop("query_text"), hits, CITED_FROM)
    return log.select("query_id", "call_id", "turn_no", "tenant_id",
                      F.array_join(F.transform("citations", lambda x: F.concat_ws("=", x["chunk_id"], x["score"].cast("string"))), ",").alias("citations"),
                      "best_score", "context_used", "escalate")


CITED_FROM = 0.5
CALLERS = dict({
    "ch": CHUNKS_SQL,
    "pas": PASSAGES["pas"],
    "qs": "SELECT call_id * 100 + turn_no AS query_id, call_id, turn_no, tenant_id, content AS query_text FROM v_turns WHERE role = 'caller'",
}, **hash_sql("pas", "chunk_id", "chunk"), **hash_sql("qs", "query_id", "query_text"))
CALLERS["ps"] = PASSAGES["ps"].replace("v_eval_v", "qs_v").replace("v_eval", "qs")
CALLERS["h"] = PASSAGES["ph"]

register("k16_log_retrieval", with_views(f"""
SELECT q.query_id, q.call_id, q.turn_no, q.tenant_id,
  coalesce(string_agg(h.chunk_id || '=' || CAST(h.score AS VARCHAR), ',' ORDER BY h.rank), '') AS citations,
  max(h.score) AS best_score,
  coalesce(max(h.score) >= {CITED_FROM}, false) AS context_used,
  NOT coalesce(max(h.score) >= {CITED_FROM}, false) AS escalate
FROM qs q LEFT JOIN h ON h.query_id = q.query_id GROUP BY ALL
""", "v_docs", "v_turns", extra=CALLERS))(_k16)
