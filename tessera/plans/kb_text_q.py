"""Registered queries: knowledge text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import simple_tokens
from ..operators import kb_text as K
from ..operators import vector_store as VS
from ..operators.common import materialize
from ..session import shared_path
from .registry import V, register, tables, with_views

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


def tok(c: str) -> str:
    return TOK.format(c=c)


CHUNKS_SQL = """
SELECT doc_id, tenant_id, chunk_no, chunk_no * 680 AS start, substr(content, chunk_no * 680 + 1, 800) AS chunk FROM (
  SELECT doc_id, tenant_id, content, unnest(range(0, n)) AS chunk_no FROM (
    SELECT *, CASE WHEN coalesce(length(content), 0) = 0 THEN 0 WHEN length(content) <= 800 THEN 1
                   ELSE CAST(ceil((length(content) - 120) / 680) AS INTEGER) END AS n FROM v_docs))"""


def _k1(spark, sf):
    return K.chunk_documents(V.docs(tables(spark, sf)))


register("k1_chunk_documents", with_views("SELECT * FROM ch", "v_docs", extra={"ch": CHUNKS_SQL}))(_k1)


def _k1r(spark, sf):
    return K.chunk_documents_recursive(V.docs(tables(spark, sf)))


# DuckDB form of the recursive splitter: a recursive CTE cuts texts into
# pieces (paragraph, line, word, then fixed slices), a second one folds the
# pieces in order into chunks with the carried overlap.
RECURSIVE_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, CAST(substr(source, 4, 10) AS INTEGER) AS tenant_id, text AS content FROM documents),
p(doc_id, path, txt, si, done) AS (
  SELECT doc_id, [0], content, 0, length(content) <= 800 FROM d WHERE length(content) > 0
  UNION ALL
  SELECT doc_id, list_append(path, k), part, nsi, length(part) <= 800 OR sep = '' FROM (
    SELECT doc_id, path, sep, nsi, unnest(range(0, len(parts))) AS k, unnest(parts) AS part FROM (
      SELECT doc_id, path, sep, nsi,
        CASE WHEN sep = '' THEN list_transform(range(0, CAST(ceil(length(txt) / 800) AS BIGINT)), lambda i: substr(txt, i * 800 + 1, 800))
             ELSE list_transform(range(0, len(string_split(txt, sep))),
                    lambda i: string_split(txt, sep)[i + 1] || CASE WHEN i < len(string_split(txt, sep)) - 1 THEN sep ELSE '' END)
        END AS parts
      FROM (SELECT doc_id, path, txt,
              CASE WHEN si <= 0 AND contains(txt, chr(10) || chr(10)) THEN chr(10) || chr(10)
                   WHEN si <= 1 AND contains(txt, chr(10)) THEN chr(10)
                   WHEN si <= 2 AND contains(txt, ' ') THEN ' ' ELSE '' END AS sep,
              CASE WHEN si <= 0 AND contains(txt, chr(10) || chr(10)) THEN 1
                   WHEN si <= 1 AND contains(txt, chr(10)) THEN 2
                   WHEN si <= 2 AND contains(txt, ' ') THEN 3 ELSE 4 END AS nsi
            FROM p WHERE NOT done)))
  WHERE length(part) > 0),
pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS idx, txt AS piece FROM p WHERE done),
m(doc_id, idx, cur, cur_start, pos, e_start, e_text) AS (
  SELECT doc_id, 0, '', 0, 0, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT doc_id FROM pc)
  UNION ALL
  SELECT m.doc_id, m.idx + 1,
    (CASE WHEN f THEN tl ELSE m.cur END) || pc.piece,
    CASE WHEN (CASE WHEN f THEN tl ELSE m.cur END) = '' THEN m.pos
         WHEN f THEN m.pos - length(tl) ELSE m.cur_start END,
    m.pos + length(pc.piece),
    CASE WHEN f THEN m.cur_start END, CASE WHEN f THEN m.cur END
  FROM m JOIN pc ON pc.doc_id = m.doc_id AND pc.idx = m.idx + 1,
  LATERAL (SELECT m.cur <> '' AND length(m.cur) + length(pc.piece) > 800 AS f) a,
  LATERAL (SELECT CASE WHEN length(right(m.cur, 120)) + length(pc.piece) > 800 THEN '' ELSE right(m.cur, 120) END AS tl) b),
em AS (
  SELECT doc_id, idx, e_start AS start, e_text AS chunk FROM m WHERE e_text IS NOT NULL
  UNION ALL
  SELECT doc_id, idx + 1, cur_start, cur FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) AS rn FROM m) WHERE rn = 1 AND cur <> '')
SELECT e.doc_id, d.tenant_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.idx) - 1 AS INTEGER) AS chunk_no,
  CAST(e.start AS INTEGER) AS start, e.chunk
FROM em e JOIN d ON d.doc_id = e.doc_id
"""

register("k1_chunk_documents_recursive", RECURSIVE_SQL)(_k1r)


def _k2(spark, sf):
    p = tables(spark, sf).pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("tenant_id"),
                                       F.col("html").alias("content"))
    return K.split_sections(p)


SECTIONS_SQL = r"""
SELECT doc_id, tenant_id, section_no, heading, section FROM (
  SELECT page_id AS doc_id, 0 AS tenant_id, section_no, section,
    nullif(trim(coalesce(nullif(regexp_extract(section, '^#{1,6} +([^\n]*)', 1), ''),
                         regexp_extract(section, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1))), '') AS heading
  FROM (
    SELECT page_id, unnest(range(0, len(secs))) AS section_no, unnest(secs) AS section FROM (
      SELECT page_id, list_concat([parts[1]],
               list_transform(range(1, len(parts)), lambda i: delims[i] || parts[i + 1])) AS secs
      FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<h[1-6][ >]') AS parts,
                   regexp_extract_all(html, '(?i)<h[1-6][ >]') AS delims FROM pages))))
WHERE length(trim(section)) > 0
"""

register("k2_split_sections", SECTIONS_SQL)(_k2)

QA_SQL = """
SELECT q.call_id, q.tenant_id, q.turn_no AS q_turn, q.content AS question, a.content AS answer
FROM v_turns q JOIN v_turns a ON a.call_id = q.call_id AND a.turn_no - 1 = q.turn_no
WHERE q.role = 'caller' AND a.role = 'agent'"""


def _k3(spark, sf):
    return K.qa_chunks(K.qa_from_turns(V.turns(tables(spark, sf))))


register("k3_qa_chunks", with_views("""
SELECT *, 'Q: ' || question || chr(10) || 'A: ' || answer AS chunk FROM qa
""", "v_turns", extra={"qa": QA_SQL}))(_k3)


def _k4(spark, sf):
    t = tables(spark, sf)
    d = V.docs(t)
    out = K.tag_chunks(K.chunk_documents(d), d, V.tenants(t))
    return out.select("doc_id", "tenant_id", "chunk_no", "title", "source", "lang", "tenant_name", "sector",
                      F.col("metadata")["language"].alias("meta_language"),
                      F.col("metadata")["sector"].alias("meta_sector"))


register("k4_tag_chunks", with_views("""
SELECT ch.doc_id, ch.tenant_id, ch.chunk_no, d.title, d.source, d.lang, t.name AS tenant_name, t.sector,
  d.lang AS meta_language, t.sector AS meta_sector
FROM ch LEFT JOIN v_docs d ON d.doc_id = ch.doc_id LEFT JOIN v_tenants t ON t.tenant_id = ch.tenant_id
""", "v_docs", "v_tenants", extra={"ch": CHUNKS_SQL}))(_k4)


def _k4s(spark, sf):
    """Chunks of the web pages' sections, tagged with their heading (K2 to K4)."""
    t = tables(spark, sf)
    p = t.pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 25).cast("int").alias("tenant_id"), F.col("html").alias("content"))
    d = t.pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), F.lit("web").alias("source"), F.lit("xx").alias("lang"))
    ch = K.chunk_documents(K.split_sections(p), text_col="section", keep=("doc_id", "tenant_id", "section_no", "heading"))
    return K.tag_chunks(ch, d, V.tenants(t)).select("doc_id", "section_no", "chunk_no", F.col("metadata")["section"].alias("meta_section"),
                                                    F.col("metadata")["title"].alias("meta_title"), F.length("chunk").alias("chunk_chars"))


register("k4_tag_sections", f"""
SELECT doc_id, section_no, chunk_no, heading AS meta_section, url AS meta_title, length(substr(section, chunk_no * 680 + 1, 800)) AS chunk_chars
FROM (SELECT s.*, p.url, unnest(range(0, CASE WHEN length(section) <= 800 THEN 1
        ELSE CAST(ceil((length(section) - 120) / 680) AS INTEGER) END)) AS chunk_no
      FROM ({SECTIONS_SQL}) s JOIN pages p ON p.page_id = s.doc_id)""")(_k4s)


def _k5(spark, sf):
    return K.extract_pages(tables(spark, sf).pages)


# The character references of the test pages (some lost their semicolon).
_DECODE = "regexp_replace(regexp_replace(replace(replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&copy;', '©'), '&middot;', '·'), " \
          "'&(lt|gt);', '?', 'g'), '&amp;?', '&', 'g')"


def _dec(x: str) -> str:
    return _DECODE.format(x=x)


register("k5_extract_pages", f"""
SELECT page_id, url,
  trim(regexp_replace({_dec("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '[ \\t\\r\\n]+', ' ', 'g')) AS title,
  trim(regexp_replace({_dec('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
      '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '<[^>]*>', ' ', 'g')''')}, '[ \\t\\r\\n]+', ' ', 'g')) AS text
FROM pages""")(_k5)


def _moved(old):
    """The corpus after a while: Spanish documents gone, German ones edited,
    French ones moved to the next tenant, some texts lost."""
    return old.filter(F.col("lang") != "es").withColumn(
        "content", F.when(F.col("doc_id") % 97 == 5, F.lit(None).cast("string"))
                    .when(F.col("lang") == "de", F.concat("content", F.lit(" (updated)"))).otherwise(F.col("content"))) \
        .withColumn("tenant_id", F.when(F.col("lang") == "fr", (F.col("tenant_id") + 1).cast("int")).otherwise(F.col("tenant_id")))


MOVED_SQL = """SELECT doc_id, CASE WHEN lang = 'fr' THEN CAST(tenant_id + 1 AS INTEGER) ELSE tenant_id END AS tenant_id,
  CASE WHEN doc_id % 97 = 5 THEN NULL WHEN lang = 'de' THEN content || ' (updated)' ELSE content END AS content
  FROM v_docs WHERE lang <> 'es'"""
def digest():
    """Contents of a document's chunks, whatever their order."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("/", "tenant_id", "chunk_no", "chunk")), 1, 8), 16, 10).cast("long"))


DIGEST_SQL = "CAST(sum(CAST('0x' || substr(md5(concat_ws('/', tenant_id, chunk_no, chunk)), 1, 8) AS BIGINT)) AS BIGINT)"


def _k9(spark, sf):
    t = tables(spark, sf)
    old = V.docs(t)
    plan, chunks = K.reindex(_moved(old), old, K.chunk_documents(old))
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), digest().alias("digest"))
    return plan.select("doc_id", "tenant_id", "action").join(n, "doc_id", "left") \
        .select("doc_id", "tenant_id", "action", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "digest")


register("k9_reindex", with_views(f"""
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.tenant_id ELSE n.tenant_id END AS tenant_id,
  CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed'
       WHEN n.tenant_id = o.tenant_id AND n.content IS NOT DISTINCT FROM o.content THEN 'unchanged' ELSE 'changed' END AS action,
  coalesce(c.n, 0) AS n_chunks, c.digest
FROM nd n FULL JOIN v_docs o ON n.doc_id = o.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, {DIGEST_SQL} AS digest FROM nch GROUP BY doc_id) c ON c.doc_id = n.doc_id
""", "v_docs", extra={"nd": MOVED_SQL, "nch": CHUNKS_SQL.replace("v_docs", "nd")}))(_k9)

TERMS = {
    "tk": f"SELECT tenant_id, doc_id, unnest({tok('content')}) AS term FROM v_docs",
    "tf": "SELECT tenant_id, doc_id, term, count(*) AS tf FROM tk GROUP BY ALL",
}


def _k11(spark, sf):
    _, df = K.build_terms(V.docs(tables(spark, sf)), id_col="doc_id")
    return df


register("k11_build_terms", with_views("""
SELECT tenant_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY ALL
""", "v_docs", extra=TERMS))(_k11)

def _k11p(spark, sf):
    return K.build_postings(V.docs(tables(spark, sf)))


register("k11_postings", with_views(f"""
SELECT tenant_id, doc_id, NULL AS term, 0 AS tf, len({tok('coalesce(content, chr(32))')}) AS dl FROM v_docs
UNION ALL
SELECT tf.tenant_id, tf.doc_id, tf.term, tf.tf, len({tok('d.content')}) FROM tf JOIN v_docs d ON d.doc_id = tf.doc_id
""", "v_docs", extra=TERMS))(_k11p)

BM25 = dict(TERMS, **{
    "dl": f"SELECT tenant_id, doc_id, len({tok("coalesce(content, '')")}) AS dl FROM v_docs",
    "st": "SELECT tenant_id, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY tenant_id",
    "dfr": "SELECT tenant_id, term, count(*) AS df FROM tf GROUP BY ALL",
    "qt": f"SELECT DISTINCT query_id, tenant_id, term FROM (SELECT query_id, tenant_id, unnest({tok('query_text')}) AS term FROM v_eval)",
    "sc": """SELECT qt.query_id, qt.tenant_id, tf.doc_id,
               round(sum(ln(1 + (st.n_docs - dfr.df + 0.5) / (dfr.df + 0.5)) * tf.tf * 2.2
                         / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))), 6) AS score
             FROM qt JOIN dfr USING (tenant_id, term) JOIN st USING (tenant_id)
               JOIN tf USING (tenant_id, term) JOIN dl ON dl.tenant_id = tf.tenant_id AND dl.doc_id = tf.doc_id
             GROUP BY ALL""",
    "kw": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
             FROM sc) WHERE rank <= 8""",
})


def _kw(t):
    return K.keyword_search(V.eval_questions(t), V.docs(t), 8)


register("k12_keyword_search", with_views("SELECT query_id, tenant_id, doc_id, score, rank FROM kw",
                                          "v_docs", "v_eval", extra=BM25))(lambda spark, sf: _kw(tables(spark, sf)))


def hash_sql(src: str, idc: str, textc: str) -> dict:
    return {
        f"{src}_b": f"""SELECT {idc}, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS bucket,
                          sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1 ELSE -1 END) AS v
                        FROM (SELECT {idc}, unnest({tok(textc)}) AS tok FROM {src}) GROUP BY ALL""",
        f"{src}_r": f"""SELECT s.{idc}, list(CAST(coalesce(b.v, 0) AS DOUBLE) ORDER BY r.i) AS raw
                        FROM {src} s CROSS JOIN range(0, 64) r(i)
                        LEFT JOIN {src}_b b ON b.{idc} = s.{idc} AND b.bucket = r.i GROUP BY s.{idc}""",
        f"{src}_v": f"""SELECT {idc}, CASE WHEN nrm > 0 THEN list_transform(raw, lambda x: x / nrm) ELSE raw END AS embedding
                        FROM (SELECT *, sqrt(list_dot_product(raw, raw)) AS nrm FROM {src}_r)""",
    }


VEC = dict(hash_sql("v_docs", "doc_id", "content"), **hash_sql("v_eval", "query_id", "query_text"))
VEC.update({
    "vs": """SELECT q.query_id, d.tenant_id, d.doc_id, round(
               list_dot_product(qv.embedding, dv.embedding) /
               CASE WHEN sqrt(list_dot_product(qv.embedding, qv.embedding)) * sqrt(list_dot_product(dv.embedding, dv.embedding)) = 0
                    THEN 1 ELSE sqrt(list_dot_product(qv.embedding, qv.embedding)) * sqrt(list_dot_product(dv.embedding, dv.embedding))
               END, 4) + 0.0 AS score
             FROM v_eval q JOIN v_eval_v qv ON qv.query_id = q.query_id
             JOIN v_docs d ON d.tenant_id = q.tenant_id JOIN v_docs_v dv ON dv.doc_id = d.doc_id""",
    "vh": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
             FROM vs) WHERE rank <= 8""",
})


def _k7(spark, sf):
    d = V.docs(tables(spark, sf))
    return K.hash_embed(d, ["doc_id"], "content", 64)


register("k7_hash_embed", with_views("SELECT doc_id, embedding FROM v_docs_v", "v_docs",
                                     extra=hash_sql("v_docs", "doc_id", "content")))(_k7)


def vector_hits(t, store: str, k: int = 8, questions=None):
    """The evaluation questions searched in the stored vectors of the documents; texts without a vector get one first."""
    d = V.docs(t)
    vecs = VS.refresh(d, store, VS.hash_embedder(), "hash", "1")
    asked = V.eval_questions(t) if questions is None else questions
    qv = K.hash_embed(asked, ["query_id", "tenant_id"], "query_text", 64).withColumnRenamed("embedding", "query_vec")
    return K.vector_search_docs(qv, VS.with_vectors(d.select("doc_id", "tenant_id", "content"), vecs), k)


def new_store(spark) -> str:
    return shared_path(spark, f"vectors-{uuid.uuid4().hex}")


def _k13(spark, sf):
    t = tables(spark, sf)
    return K.hybrid_search(vector_hits(t, new_store(spark)), _kw(t), 8)


def _k8_refresh(spark, sf):
    """The store after the corpus has moved on: which documents found their vector there."""
    t = tables(spark, sf)
    store = new_store(spark)
    VS.refresh(V.docs(t), store, VS.hash_embedder(), "hash", "1")
    now = _moved(V.docs(t)).select("doc_id", "content")
    lacking = VS.missing(now, store, "hash", "1").select("content_key", F.lit(False).alias("_stored"))
    before = materialize(now.select("doc_id", VS.key_of("content").alias("content_key")).join(lacking, "content_key", "left")
                         .select("doc_id", F.coalesce("_stored", F.lit(True)).alias("reused")))
    vecs = VS.refresh(now, store, VS.hash_embedder(), "hash", "1")
    return VS.with_vectors(now, vecs).join(before, "doc_id").select("doc_id", "reused", "embedding")


register("k8_refresh_vectors", with_views("""
SELECT n.doc_id, n.key IN (SELECT sha256(coalesce(content, '')) FROM v_docs) AS reused, v.embedding
FROM (SELECT doc_id, sha256(coalesce(content, '')) AS key FROM nd) n JOIN nd_v v ON v.doc_id = n.doc_id
""", "v_docs", extra=dict({"nd": MOVED_SQL}, **hash_sql("nd", "doc_id", "content"))))(_k8_refresh)


HYB = dict(BM25, **VEC)
HYB["hy"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id,
    v.rank AS v_rank, k.rank AS k_rank,
    round(coalesce(1.0 / (60 + v.rank), 0.0) + coalesce(1.0 / (60 + k.rank), 0.0), 8) AS rrf
  FROM vh v FULL JOIN kw k ON v.query_id = k.query_id AND v.doc_id = k.doc_id)) WHERE rank <= 8"""

register("k13_hybrid_search", with_views("SELECT query_id, doc_id, v_rank, k_rank, rrf, rank FROM hy",
                                         "v_docs", "v_eval", extra=HYB))(_k13)


def evaluation_set(t):
    """The evaluation questions, and for each tenant and language eight words in a row of its newest document."""
    d = V.docs(t)
    newest = d.groupBy("tenant_id", "lang").agg(F.max_by("content", "doc_id").alias("content"), F.max("doc_id").alias("doc_id"))
    words = F.slice(simple_tokens("content"), 5, 8)
    from_docs = newest.select((F.col("doc_id") + 10_000_000_000).alias("query_id"), "tenant_id", F.array_join(words, " ").alias("query_text"))
    return V.eval_questions(t).unionByName(from_docs)


def _k17(spark, sf):
    t = tables(spark, sf)
    q = materialize(evaluation_set(t))
    expected = K.passage_matches(V.docs(t), q)
    hits = K.hybrid_search(vector_hits(t, new_store(spark), questions=q), K.keyword_search(q, V.docs(t), 8), 8)
    return K.evaluate(hits, expected, q, 8)


EVALSET = {"eq": f"""SELECT query_id, tenant_id, query_text FROM v_eval UNION ALL
    SELECT max(doc_id) + 10000000000, tenant_id, array_to_string({tok('arg_max(content, doc_id)')}[5:12], ' ') FROM v_docs GROUP BY tenant_id, lang"""}
EVAL = dict(EVALSET, **{k.replace("v_eval", "eq"): v.replace("v_eval", "eq") for k, v in HYB.items()})
EVAL.update(**{
    "ex": f"""SELECT q.query_id, d.doc_id FROM eq q JOIN v_docs d ON d.tenant_id = q.tenant_id
             WHERE len({tok('q.query_text')}) > 0 AND contains(' ' || array_to_string({tok('d.content')}, ' ') || ' ',
                                ' ' || array_to_string({tok('q.query_text')}, ' ') || ' ')""",
    "ne": "SELECT query_id, count(*) AS n FROM ex GROUP BY query_id",
    "nf": """SELECT h.query_id, count(*) AS n, min(h.rank) AS fr FROM hy h JOIN ex e
             ON e.query_id = h.query_id AND e.doc_id = h.doc_id GROUP BY h.query_id""",
})

EVAL_SQL = """
SELECT q.query_id, coalesce(ne.n, 0) AS n_expected, coalesce(nf.n, 0) AS n_found,
  CASE WHEN coalesce(ne.n, 0) > 0 THEN round(coalesce(nf.n, 0) / ne.n, 6) END AS recall_at_k,
  CASE WHEN coalesce(ne.n, 0) > 0 THEN coalesce(round(1.0 / nf.fr, 6), 0.0) END AS reciprocal_rank,
  coalesce(ne.n, 0) > 0 AS answerable
FROM eq q LEFT JOIN ne ON ne.query_id = q.query_id LEFT JOIN nf ON nf.query_id = q.query_id
"""
register("k17_evaluate", with_views(EVAL_SQL, "v_docs", "v_eval", extra=EVAL))(_k17)


def _k17s(spark, sf):
    t = tables(spark, sf)
    return K.summarise_evaluation(_k17(spark, sf), evaluation_set(t), V.tenants(t))


EVAL["ev"] = EVAL_SQL
register("k17_summary", with_views("""
SELECT t.sector, CAST(grouping(t.sector) AS INTEGER) AS overall, count(*) AS questions,
  round(avg(CAST(answerable AS INTEGER)), 4) AS answerable_share,
  round(avg(recall_at_k) FILTER (WHERE answerable), 4) AS recall_at_k, round(avg(reciprocal_rank) FILTER (WHERE answerable), 4) AS mrr,
  round(avg(CASE WHEN n_found > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE answerable), 4) AS contained_share
FROM ev JOIN eq q ON q.query_id = ev.query_id LEFT JOIN v_tenants t ON t.tenant_id = q.tenant_id GROUP BY ROLLUP (t.sector)
""", "v_docs", "v_eval", "v_tenants", extra=EVAL))(_k17s)


def _s3(spark, sf):
    p = tables(spark, sf).part.withColumn("tenant_id", (F.col("p_partkey") % 25).cast("int"))
    return K.rows_to_chunks(p, "p_name", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


S3_SQL = """
SELECT CAST(p_partkey % 25 AS INTEGER) AS tenant_id, p_name AS title,
  concat_ws('; ', 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type,
            'p_size: ' || CAST(p_size AS VARCHAR), 'p_retailprice: ' || CAST(p_retailprice AS VARCHAR)) AS chunk,
  sha256(concat_ws(chr(31), coalesce(p_name, '\\N'), coalesce(p_brand, '\\N'), coalesce(p_type, '\\N'),
         coalesce(CAST(p_size AS VARCHAR), '\\N'), coalesce(CAST(p_retailprice AS VARCHAR), '\\N'))) AS chunk_key
FROM part"""
register("s3_rows_to_chunks", S3_SQL)(_s3)


def _u2(spark, sf):
    t = tables(spark, sf)
    ch = K.chunk_documents(V.docs(t))
    qa = K.qa_chunks(K.qa_from_turns(V.turns(t)))
    rows = _s3(spark, sf)
    return K.union_knowledge(ch, qa, rows).select("tenant_id", "kind", "chunk")


register("u2_union_knowledge", with_views("""
SELECT tenant_id, 'document' AS kind, chunk FROM ch
UNION ALL SELECT tenant_id, 'qa', 'Q: ' || question || chr(10) || 'A: ' || answer FROM qa
UNION ALL SELECT tenant_id, 'row', chunk FROM s3
""", "v_docs", "v_turns", extra={"ch": CHUNKS_SQL, "qa": QA_SQL, "s3": S3_SQL}))(_u2)
