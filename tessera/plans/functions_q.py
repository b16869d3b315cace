"""Registered queries: scalar helpers (X1-X10, X12, X13), quality and privacy
(Q1-Q6) and caller code / models (E1, E2, K7, K8)."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import ts_lit
from ..operators import kb_search as S
from ..operators import models as M
from ..operators import quality as Q
from ..operators import requests as R
from ..operators.kb_text import chunk_documents
from ..sources import landing as L
from . import landing_sql as LS
from .kb_search_q import COS, HITS
from .kb_text_q import CHUNKS_SQL, MOVED_SQL, hash_sql, _moved
from .registry import V, register, tables, with_views
from .reports_q import QHITS, _qhits
from .rules_q import E164_SQL

# X1 -----------------------------------------------------------------------
register("x1_first_of", with_views("""
SELECT call_id, line_no, part_id, coalesce(customer_email, customer_phone, 'no contact') AS contact FROM v_bookings
""", "v_bookings"))(lambda spark, sf: V.bookings(tables(spark, sf)).select(
    "call_id", "line_no", "part_id", X.first_of("customer_email", "customer_phone", default="no contact").alias("contact")))

# X2 -----------------------------------------------------------------------
register("x2_falsy_or", with_views("""
SELECT call_id, CASE WHEN duration_sec IS NULL OR duration_sec = 0 THEN -1 ELSE duration_sec END AS duration_sec,
  CASE WHEN outcome IS NULL OR outcome = '' THEN 'unknown' ELSE outcome END AS outcome FROM v_calls
""", "v_calls"))(lambda spark, sf: V.calls(tables(spark, sf)).select(
    "call_id", X.falsy_or("duration_sec", -1, numeric=True).alias("duration_sec"),
    X.falsy_or("outcome", "unknown").alias("outcome")))


# X3 -----------------------------------------------------------------------
def _x3(spark, sf):
    n = R.normalize_tool_call(L.tool_requests(tables(spark, sf)))
    return n.select("request_id", X.blank_cast("callId", "bigint").alias("call_id"),
                    X.blank_cast_failed("callId", "bigint").alias("bad_call_id"),
                    X.blank_cast("datetime", "timestamp_ntz").alias("at_time"),
                    X.blank_cast_failed("datetime", "timestamp_ntz").alias("bad_time"))


register("x3_blank_cast", with_views("""
SELECT request_id, TRY_CAST(NULLIF("callId", '') AS BIGINT) AS call_id,
  NULLIF("callId", '') IS NOT NULL AND TRY_CAST(NULLIF("callId", '') AS BIGINT) IS NULL AS bad_call_id,
  TRY_CAST(NULLIF(datetime, '') AS TIMESTAMP) AS at_time,
  NULLIF(datetime, '') IS NOT NULL AND TRY_CAST(NULLIF(datetime, '') AS TIMESTAMP) IS NULL AS bad_time
FROM nrm
""", extra={"lnd": LS.TOOL, "nrm": LS.normalised("lnd", LS.TOOL_FIELDS)}))(_x3)


# X4 -----------------------------------------------------------------------
def _x4(spark, sf):
    t = tables(spark, sf)
    n = V.notifications(t).select("notification_id", X.details(channel="channel", status="status").alias("details"),
                                  F.from_json("props", "struct<k:int>")["k"].alias("k"))
    v = V.chunks(t).select("chunk_id", F.size(X.parse_vector(F.to_json("embedding"))).alias("dims"))
    return n.join(v, n.notification_id == v.chunk_id, "left").drop("chunk_id")


register("x4_details", with_views("""
SELECT n.notification_id, to_json(struct_pack(channel := n.channel, status := n.status)) AS details,
  CAST(json_extract(n.props, '$.k') AS INTEGER) AS k, len(c.embedding) AS dims
FROM v_notifications n LEFT JOIN v_chunks c ON c.chunk_id = n.notification_id
""", "v_notifications", "v_chunks"))(_x4)


# X5 / X6 ----------------------------------------------------------------------
def _pairs(spark, sf):
    c = V.chunks(tables(spark, sf))
    nxt = c.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("chunk_id").alias("next_id"),
                   F.col("embedding").alias("next_vec"))
    return c.join(nxt, "chunk_id", "inner")


PAIRS_COS = COS.replace("q.query_vec", "n.embedding")
register("x5_cosine", with_views(f"""
SELECT c.chunk_id, n.chunk_id AS next_id, round({PAIRS_COS}, 4) + 0.0 AS score
FROM v_chunks c JOIN v_chunks n ON n.chunk_id = c.chunk_id + 1
""", "v_chunks"))(lambda spark, sf: _pairs(spark, sf).select(
    "chunk_id", "next_id", X.score4(X.cosine("next_vec", "embedding")).alias("score")))

register("x6_cosine_distance", with_views(f"""
SELECT c.chunk_id, n.chunk_id AS next_id, round(1.0 - {PAIRS_COS}, 4) + 0.0 AS distance
FROM v_chunks c JOIN v_chunks n ON n.chunk_id = c.chunk_id + 1
""", "v_chunks"))(lambda spark, sf: _pairs(spark, sf).select(
    "chunk_id", "next_id", X.score4(X.cosine_distance("next_vec", "embedding")).alias("distance")))

# X7 -----------------------------------------------------------------------
register("x7_score4", """
SELECT o_orderkey, round(o_totalprice / 7, 4) + 0.0 AS price_per_seat FROM orders
""")(lambda spark, sf: tables(spark, sf).orders.select(
    "o_orderkey", X.score4(F.col("o_totalprice") / 7).alias("price_per_seat")))

# X8 -----------------------------------------------------------------------
register("x8_simple_tokens", with_views("""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (
  SELECT doc_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM v_docs)
""", "v_docs"))(lambda spark, sf: V.docs(tables(spark, sf)).select(
    "doc_id", F.size(X.simple_tokens("content")).alias("n_tokens"),
    F.size(F.array_distinct(X.simple_tokens("content"))).alias("n_distinct")))


# X9 -----------------------------------------------------------------------
def _x9(spark, sf):
    n = R.normalize_tool_call(L.tool_requests(tables(spark, sf)))
    return n.select("request_id", "phone", X.e164("phone").alias("e164"))


_D = "regexp_replace(trim(phone), '[^0-9]', '', 'g')"
E164_CASE = f"""CASE WHEN starts_with(trim(phone), '+') THEN '+' || {_D}
  WHEN starts_with({_D}, '00') THEN '+' || substr({_D}, 3)
  WHEN length({_D}) > 10 THEN '+' || {_D} ELSE '+1' || {_D} END"""
register("x9_e164", with_views(f"""
SELECT request_id, phone, {E164_SQL.format(x='p')} AS e164 FROM (SELECT request_id, phone, {E164_CASE} AS p FROM nrm)
""", extra={"lnd": LS.TOOL, "nrm": LS.normalised("lnd", LS.TOOL_FIELDS)}))(_x9)


# X10 ----------------------------------------------------------------------
def _x10(spark, sf):
    ch = V.chunks(tables(spark, sf))
    hits = S.search(S.probe_queries(ch), ch, 3)
    g = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("h"))
    return g.select("query_id", X.join_top(F.transform("h", lambda x: x["chunk_id"].cast("string")), 2, "\n---\n")
                    .alias("top2"))


register("x10_join_top", with_views("""
SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), chr(10) || '---' || chr(10) ORDER BY rank) AS top2
FROM h WHERE rank <= 2 GROUP BY query_id
""", "v_chunks", extra=HITS))(_x10)

# X12 ----------------------------------------------------------------------
register("x12_content_key", with_views("""
SELECT lead_id, sha256(concat_ws(chr(31), coalesce(CAST(tenant_id AS VARCHAR), '\\N'), coalesce(email, '\\N'))) AS key
FROM v_leads
""", "v_leads"))(lambda spark, sf: V.leads(tables(spark, sf)).select(
    "lead_id", X.content_key("tenant_id", "email").alias("key")))


# X13 ----------------------------------------------------------------------
def _x13(spark, sf):
    d = V.docs(tables(spark, sf)).select("doc_id", X.storage_key("tenant_id", F.concat(F.col("source"), F.lit("/"),
                                                                                       F.col("doc_id").cast("string"),
                                                                                       F.lit(".txt"))).alias("key"))
    return d.select("doc_id", "key", X.storage_tenant("key").alias("tenant"), X.storage_name("key").alias("name"))


register("x13_storage_key", with_views("""
SELECT doc_id, key, nullif(regexp_extract(key, '^tenants/([^/]+)/', 1), '') AS tenant,
  nullif(regexp_extract(key, '^tenants/[^/]+/(.+)$', 1), '') AS name FROM (
  SELECT doc_id, 'tenants/' || CAST(tenant_id AS VARCHAR) || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key
  FROM v_docs)
""", "v_docs"))(_x13)


# Q1-Q6 ----------------------------------------------------------------------
CALL_STATUSES = ("active", "completed", "failed", "missed")


def _q1(spark, sf):
    c = V.calls(tables(spark, sf)).select("call_id", "provider", "status")
    out = Q.check_domains(c, {"provider": Q.DOMAINS["provider"], "status": CALL_STATUSES})
    return out.select("call_id", F.array_join("failed", ",").alias("failed"), "ok")


register("q1_check_domains", with_views("""
SELECT call_id, array_to_string(f, ',') AS failed, len(f) = 0 AS ok FROM (
  SELECT call_id, list_filter([CASE WHEN NOT coalesce(provider IN ('twilio', 'sip', 'plivo', 'vonage'), false) THEN 'provider' END,
    CASE WHEN NOT coalesce(status IN ('active', 'completed', 'failed', 'missed'), false) THEN 'status' END],
    lambda x: x IS NOT NULL) AS f FROM v_calls)
""", "v_calls"))(_q1)

register("q2_check_keys", with_views("""
SELECT call_id, line_no, count(*) AS rows,
  CASE WHEN call_id IS NULL OR line_no IS NULL THEN 'missing_key' ELSE 'duplicate_key' END AS problem
FROM (SELECT nullif(call_id, 7) AS call_id, line_no FROM v_bookings)
GROUP BY call_id, line_no HAVING count(*) > 1 OR call_id IS NULL OR line_no IS NULL
""", "v_bookings"))(lambda spark, sf: Q.check_keys(      # the call id of one call is lost
    V.bookings(tables(spark, sf)).withColumn("call_id", F.nullif(F.col("call_id"), F.lit(7))), ["call_id", "line_no"]))


def _q3(spark, sf):
    t = tables(spark, sf)
    # the calls that retention has left: children of older ones are orphans
    calls, tenants = V.calls(t).filter(F.col("started_at") >= ts_lit(dt.datetime(1996, 1, 1))), V.tenants(t)
    checks = [("bookings.call_id", Q.check_refs(V.bookings(t), calls, "call_id")),
              ("notifications.call_id", Q.check_refs(V.notifications(t), calls, "call_id")),
              ("turns.call_id", Q.check_refs(V.turns(t), calls, "call_id")),
              ("calls.tenant_id", Q.check_refs(calls, tenants, "tenant_id")),
              ("configs.tenant_id", Q.check_refs(V.configs(t), tenants, "tenant_id")),
              ("labels.doc_id", Q.check_refs(t.labels, t.documents, "doc_id"))]
    out = None
    for name, df in checks:
        part = df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


def _orphans(name, child, parent, fk):
    return (f"SELECT '{name}' AS \"check\", count(*) AS orphans FROM {child} c WHERE c.{fk} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{fk} = c.{fk})")


register("q3_check_refs", with_views(" UNION ALL ".join([
    _orphans("bookings.call_id", "v_bookings", "left_calls", "call_id"),
    _orphans("notifications.call_id", "v_notifications", "left_calls", "call_id"),
    _orphans("turns.call_id", "v_turns", "left_calls", "call_id"),
    _orphans("calls.tenant_id", "left_calls", "v_tenants", "tenant_id"),
    _orphans("configs.tenant_id", "v_configs", "v_tenants", "tenant_id"),
    _orphans("labels.doc_id", "labels", "documents", "doc_id")]),
    "v_bookings", "v_calls", "v_notifications", "v_turns", "v_tenants", "v_configs",
    extra={"left_calls": "SELECT * FROM v_calls WHERE started_at >= TIMESTAMP '1996-01-01'"}))(_q3)


def _q4(spark, sf):
    t = tables(spark, sf)
    calls = V.calls(t)
    a = Q.audit_isolation(V.bookings(t), calls, "call_id", "bookings_vs_call")
    b = Q.audit_isolation(V.notifications(t), calls, "call_id", "notifications_vs_call")
    c = Q.audit_isolation(V.turns(t), calls, "call_id", "turns_vs_call")
    # chunks of an older index against documents some of which have moved to
    # another tenant, and citations of those documents by caller turns
    docs = _moved(V.docs(t))
    d = Q.audit_isolation(chunk_documents(V.docs(t)).select("doc_id", "tenant_id"), docs, "doc_id", "chunks_vs_document")
    e = Q.audit_isolation(_qhits(t).select("doc_id", "tenant_id"), docs, "doc_id", "citations_vs_document")
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def _iso_doc(name, child):
    return (f"SELECT '{name}' AS \"check\", count(*) AS checked, count(*) FILTER (WHERE x.tenant_id <> d.tenant_id) "
            f"AS mismatches FROM {child} x JOIN nd d ON d.doc_id = x.doc_id")


def _iso(name, child):
    return (f"SELECT '{name}' AS \"check\", count(*) AS checked, count(*) FILTER (WHERE x.tenant_id <> c.tenant_id) "
            f"AS mismatches FROM {child} x JOIN v_calls c ON c.call_id = x.call_id")


register("q4_audit_isolation", with_views(" UNION ALL ".join([
    _iso("bookings_vs_call", "v_bookings"), _iso("notifications_vs_call", "v_notifications"),
    _iso("turns_vs_call", "v_turns"), _iso_doc("chunks_vs_document", "ch"), _iso_doc("citations_vs_document", "kw")]),
    "v_bookings", "v_notifications", "v_turns", "v_calls", "v_docs", extra=dict(QHITS, nd=MOVED_SQL, ch=CHUNKS_SQL)))(_q4)


def _q5(spark, sf):
    d = V.docs(tables(spark, sf)).select("doc_id", "content")
    return Q.redact(d, "content")


_EM = Q.EMAIL_PATTERN
_PH = Q.PHONE_PATTERN
register("q5_redact", with_views(f"""
SELECT doc_id, regexp_replace(nm, '{_PH}', '[phone]', 'g') AS content,
  len(regexp_extract_all(content, '{_EM}')) AS n_emails, len(regexp_extract_all(nm, '{_PH}')) AS n_phones
FROM (SELECT doc_id, content, regexp_replace(content, '{_EM}', '[email]', 'g') AS nm FROM v_docs)
""", "v_docs"))(_q5)

SALT = "tenant-salt-2024"
register("q6_pseudonymise", with_views(f"""
SELECT lead_id, tenant_id, CASE WHEN phone IS NOT NULL THEN sha256('{SALT}' || phone) END AS phone,
  CASE WHEN email IS NOT NULL THEN sha256('{SALT}' || email) END AS email FROM v_leads
""", "v_leads"))(lambda spark, sf: Q.pseudonymise(V.leads(tables(spark, sf)).select(
    "lead_id", "tenant_id", "phone", "email"), ["phone", "email"], SALT))


# E1 / E2 / K7 / K8 ----------------------------------------------------------------
def _text_stats(pdf: pd.DataFrame) -> pd.DataFrame:
    s = pdf["content"].fillna("")
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": s.str.count("\n") + 1,
                         "n_words": s.str.split().str.len().fillna(0).astype("int64")})


register("e1_apply_batch", with_views("""
SELECT doc_id, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n_lines,
  CAST(len(regexp_extract_all(content, '[^ \t\n\r\f\v]+')) AS BIGINT) AS n_words FROM v_docs
""", "v_docs"))(lambda spark, sf: M.apply_batch(
    V.docs(tables(spark, sf)).select("doc_id", "content"), _text_stats, "doc_id long, n_lines long, n_words long"))


# The stand-in model's word lists.
POSITIVE = ("good", "great", "thanks", "bien", "gut", "bueno", "the")
NEGATIVE = ("bad", "never", "mal", "schlecht", "malo", "not")


_SQL_POS = "(" + ", ".join(f"'{w}'" for w in POSITIVE) + ")"
_SQL_NEG = "(" + ", ".join(f"'{w}'" for w in NEGATIVE) + ")"


def _sentiment_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in model: word-list sentiment over the words of the text; fails
    on empty text (to exercise the error path)."""
    if (pdf["content"].fillna("").str.len() == 0).any():
        raise ValueError("empty text")
    score = []
    for t in pdf["content"]:
        ws = M.words(t)
        score.append(sum(w in POSITIVE for w in ws) - sum(w in NEGATIVE for w in ws))
    lab = pd.Series(score).clip(-1, 1).map({-1: "negative", 0: "neutral", 1: "positive"})
    return pd.DataFrame({"sentiment": lab})


register("e2_apply_model", with_views(f"""
SELECT call_id, turn_no, CASE WHEN empty THEN NULL WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN empty THEN 'ValueError: empty text' END AS model_error FROM (
  SELECT call_id, turn_no, role = 'system' AS empty, len(list_filter(w, lambda x: x IN {_SQL_POS})) - len(list_filter(w, lambda x: x IN {_SQL_NEG})) AS d
  FROM (SELECT call_id, turn_no, role, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM v_turns))
""", "v_turns"))(lambda spark, sf: M.apply_model(
    # system turns hold no speech: their text is empty, and the model fails on it
    V.turns(tables(spark, sf)).select("call_id", "turn_no", F.when(F.col("role") == "system", "").otherwise(F.col("content")).alias("content")),
    _sentiment_model, ["content"], "sentiment string", batch=64, keep=["call_id", "turn_no"]))


def _k7(spark, sf):
    d = V.docs(tables(spark, sf))
    return M.embed(d, M.hashing_embedder(64), "content", "hashing-md5", "v1", 64, ["doc_id", "tenant_id"])


register("k7_embed", with_views("""
SELECT doc_id, tenant_id, CAST(embedding AS FLOAT[]) AS embedding, 'hashing-md5' AS model_name, 'v1' AS model_version
FROM v_docs JOIN v_docs_v USING (doc_id)
""", "v_docs", extra=hash_sql("v_docs", "doc_id", "content")))(_k7)


def _k8(spark, sf):
    """Chunks embedded with v1, then the English ones marked as an older
    version; re-embedding brings all to v2."""
    t = tables(spark, sf)
    d = V.docs(t)
    v1 = M.embed(d, M.hashing_embedder(64), "content", "hashing-md5", "v1", 64, ["doc_id", "tenant_id"])
    v1 = v1.join(d.select("doc_id", "content", "lang"), "doc_id")
    v1 = v1.withColumn("model_version", F.when(F.col("lang") == "en", F.lit("v0")).otherwise(F.lit("v2")))
    return M.reembed(v1, M.hashing_embedder(64), "content", "hashing-md5", "v2", 64, ["doc_id", "tenant_id"])


register("k8_reembed", with_views("""
SELECT doc_id, tenant_id, CAST(embedding AS FLOAT[]) AS embedding, 'hashing-md5' AS model_name, 'v2' AS model_version
FROM v_docs JOIN v_docs_v USING (doc_id)
""", "v_docs", extra=hash_sql("v_docs", "doc_id", "content")))(_k8)
