"""Registered queries: reports (A2-A17) and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kb_text as K
from ..operators import quality as Q
from ..operators import reports as RP
from ..operators.common import latest, top_k_per
from .kb_text_q import BM25, CHUNKS_SQL, tok
from .registry import V, register, tables, with_views

# Fixed values of the cost model used by the reports (our parameters; the
# reference gives none): per-minute telephony rate by provider, per token
# and per message.
PROVIDER_RATES = (("twilio", 0.0085), ("exotel", 0.006), ("plivo", 0.007), ("vonage", 0.008))
TOKEN_RATE = 0.00002
MESSAGE_RATE = 0.005
GAP_THRESHOLD = 10.0
RATES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', CAST({r} AS DOUBLE))" for p, r in PROVIDER_RATES) + \
    ") AS r(provider, rate_per_min)"


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROVIDER_RATES), "provider string, rate_per_min double")


register("a2_assemble_transcripts", with_views("""
SELECT call_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn_no) AS transcript, count(*) AS n_turns
FROM v_turns GROUP BY call_id
""", "v_turns"))(lambda spark, sf: RP.assemble_transcripts(V.turns(tables(spark, sf))))


register("a2_transcript_parts", with_views("""
SELECT call_id, (place - 1) // 4 AS part, string_agg(role || ': ' || content, chr(10) ORDER BY place) AS transcript, count(*) AS n_turns
FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn_no) AS place FROM v_turns) GROUP BY ALL
""", "v_turns"))(lambda spark, sf: RP.transcript_parts(V.turns(tables(spark, sf)), 4))


register("a3_kpi_tiles", with_views("""
SELECT c.tenant_id, CAST(c.started_at AS DATE) AS day, count(*) AS calls,
  round(avg(c.duration_sec), 2) AS avg_duration_sec,
  round(count(*) FILTER (WHERE c.outcome = 'resolved') / count(*), 4) AS resolution_rate,
  count(*) FILTER (WHERE c.escalated) AS escalations,
  round(sum(c.duration_sec * r.rate_per_min / CAST(60 AS DOUBLE)), 6) AS cost
FROM v_calls c LEFT JOIN rt r ON r.provider = c.provider GROUP BY ALL
""", "v_calls", extra={"rt": RATES_SQL}))(lambda spark, sf: RP.kpi_tiles(V.calls(tables(spark, sf)), rates(spark)))


register("a4_call_volume", with_views("""
SELECT s.tenant_id, s.bucket, coalesce(n.calls, 0) AS calls FROM (
  SELECT tenant_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS bucket FROM (
    SELECT tenant_id, min(b) AS lo, max(b) AS hi FROM (SELECT tenant_id, date_trunc('month', started_at) AS b FROM v_calls)
    GROUP BY tenant_id)) s
LEFT JOIN (SELECT tenant_id, date_trunc('month', started_at) AS bucket, count(*) AS calls FROM v_calls GROUP BY ALL) n
  ON n.tenant_id = s.tenant_id AND n.bucket = s.bucket
""", "v_calls"))(lambda spark, sf: RP.call_volume(V.calls(tables(spark, sf)), "month"))


register("a5_peak_hours", with_views("""
SELECT g.*, coalesce(p.rn = 1, false) AS is_peak FROM g LEFT JOIN (
  SELECT tenant_id, weekday, hour, row_number() OVER (PARTITION BY tenant_id ORDER BY calls DESC, weekday, hour) AS rn
  FROM g) p ON p.tenant_id = g.tenant_id AND p.weekday = g.weekday AND p.hour = g.hour AND p.rn = 1
""", "v_calls", extra={"g": """SELECT tenant_id, CAST(isodow(started_at) - 1 AS INTEGER) AS weekday,
    CAST(hour(started_at) AS INTEGER) AS hour, count(*) AS calls FROM v_calls GROUP BY ALL"""}))(
    lambda spark, sf: RP.peak_hours(V.calls(tables(spark, sf))))


register("a6_intent_breakdown", with_views("""
SELECT tenant_id, intent, calls, round(calls / sum(calls) OVER (PARTITION BY tenant_id), 4) AS share FROM (
  SELECT tenant_id, intent, count(*) AS calls FROM v_calls GROUP BY ALL)
""", "v_calls"))(lambda spark, sf: RP.intent_breakdown(V.calls(tables(spark, sf))))


register("a7_resolution_rates", with_views("""
SELECT t.sector, c.tenant_id, count(*) AS calls,
  round(count(*) FILTER (WHERE c.outcome = 'resolved') / count(*), 4) AS resolution_rate,
  round(count(*) FILTER (WHERE c.escalated) / count(*), 4) AS escalation_rate,
  CAST(grouping(t.sector, c.tenant_id) AS BIGINT) AS level
FROM v_calls c LEFT JOIN v_tenants t ON t.tenant_id = c.tenant_id
GROUP BY ROLLUP (t.sector, c.tenant_id)
""", "v_calls", "v_tenants"))(
    lambda spark, sf: (lambda t: RP.resolution_rates(V.calls(t), V.tenants(t)))(tables(spark, sf)))


# Caller questions searched (BM25, top 3) in the documents of their tenant.
QS_SQL = """SELECT call_id * 100 + turn_no AS query_id, call_id, tenant_id, content AS query_text
            FROM v_turns WHERE role = 'caller'"""
QHITS = {"qs": QS_SQL}
QHITS.update(BM25)
QHITS["qt"] = BM25["qt"].replace("FROM v_eval", "FROM qs")
QHITS["kw"] = BM25["kw"].replace("rank <= 8", "rank <= 3")
QHITS["best"] = "SELECT query_id, max(score) AS best FROM kw GROUP BY query_id"

# The same questions searched by chunk: a document's score is that of its best chunk.
QPASSAGES = {"qs": QS_SQL, "pch": CHUNKS_SQL}
QPASSAGES.update({
    "ptk": f"SELECT tenant_id, doc_id, chunk_no, unnest({tok('chunk')}) AS term FROM pch",
    "ptf": "SELECT tenant_id, doc_id, chunk_no, term, count(*) AS tf FROM ptk GROUP BY ALL",
    "pdl": f"SELECT tenant_id, doc_id, chunk_no, len({tok('chunk')}) AS dl FROM pch",
    "pst": "SELECT tenant_id, count(*) AS n_docs, avg(dl) AS avgdl FROM pdl GROUP BY tenant_id",
    "pdf": "SELECT tenant_id, term, count(*) AS df FROM ptf GROUP BY ALL",
    "qt": BM25["qt"].replace("FROM v_eval", "FROM qs"),
    "psc": """SELECT qt.query_id, qt.tenant_id, f.doc_id, f.chunk_no,
               round(sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2
                         / (f.tf + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl))), 6) AS score
             FROM qt JOIN pdf d USING (tenant_id, term) JOIN pst s USING (tenant_id)
               JOIN ptf f USING (tenant_id, term) JOIN pdl l ON l.doc_id = f.doc_id AND l.chunk_no = f.chunk_no
             GROUP BY ALL""",
    "pbest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
               SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_no) AS o FROM psc) WHERE o = 1)
             WHERE rank <= 3""",
})


def _questions(t):
    turns = V.turns(t)
    return turns.filter(F.col("role") == "caller").select(
        (F.col("call_id") * 100 + F.col("turn_no")).alias("query_id"), "call_id", "tenant_id",
        F.col("content").alias("query_text"))


def _qhits(t):
    return K.keyword_search(_questions(t), V.docs(t), 3)


register("a8_knowledge_gap", with_views(f"""
SELECT q.tenant_id, count(*) AS questions,
  count(*) FILTER (WHERE coalesce(b.best < {GAP_THRESHOLD}, true) OR coalesce(c.escalated, false)) AS gaps,
  round(count(*) FILTER (WHERE coalesce(b.best < {GAP_THRESHOLD}, true) OR coalesce(c.escalated, false)) / count(*), 4)
    AS gap_rate
FROM qs q LEFT JOIN best b ON b.query_id = q.query_id LEFT JOIN v_calls c ON c.call_id = q.call_id
GROUP BY q.tenant_id
""", "v_turns", "v_docs", "v_calls", extra=QHITS))(
    lambda spark, sf: (lambda t: RP.knowledge_gap(_questions(t), _qhits(t), V.calls(t), GAP_THRESHOLD))(tables(spark, sf)))


def _asked_again(t):
    """Caller questions, and those of every third call once more in capitals by the next caller of the tenant."""
    q = _questions(t)
    again = q.filter(F.col("call_id") % 3 == 0).select((F.col("query_id") + 50).alias("query_id"), "call_id", "tenant_id",
                                                       F.concat(F.upper("query_text"), F.lit(" ?!")).alias("query_text"))
    return q.unionByName(again)


def _a9(spark, sf):
    t = tables(spark, sf)
    q = _asked_again(t)
    return RP.gap_topics(RP.gap_questions(q, K.keyword_search(q, V.docs(t), 3), GAP_THRESHOLD), 10)


AGAIN = dict(QHITS, qs=f"""SELECT * FROM ({QS_SQL}) UNION ALL
  SELECT query_id + 50, call_id, tenant_id, upper(query_text) || ' ?!' FROM ({QS_SQL}) WHERE call_id % 3 = 0""")

register("a9_gap_topics", with_views(f"""
SELECT tenant_id, topic, asked, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY asked DESC, topic) AS rank FROM (
    SELECT q.tenant_id, array_to_string(regexp_extract_all(lower(q.query_text), '[\\p{{L}}\\p{{N}}]+'), ' ') AS topic,
      count(*) AS asked
    FROM qs q LEFT JOIN best b ON b.query_id = q.query_id
    WHERE coalesce(b.best < {GAP_THRESHOLD}, true) GROUP BY ALL)) WHERE rank <= 10
""", "v_turns", "v_docs", extra=AGAIN))(_a9)


def _a16(spark, sf):
    t = tables(spark, sf)
    cites = _qhits(t).filter(F.col("score") >= GAP_THRESHOLD).join(
        _questions(t).select("query_id", "call_id"), "query_id")
    return RP.citation_usage(cites)


register("a16_citation_usage", with_views(f"""
SELECT k.tenant_id, k.doc_id, count(*) AS citations, count(DISTINCT q.call_id) AS calls
FROM kw k JOIN qs q ON q.query_id = k.query_id WHERE k.score >= {GAP_THRESHOLD} GROUP BY ALL
""", "v_turns", "v_docs", extra=QHITS))(_a16)


register("a10_cost_per_call", with_views(f"""
SELECT c.call_id, c.tenant_id, coalesce(c.duration_sec, 0) / CAST(60 AS DOUBLE) AS minutes,
  coalesce(t.tokens, 0) AS tokens, coalesce(n.messages, 0) AS messages,
  coalesce(c.duration_sec, 0) / CAST(60 AS DOUBLE) * coalesce(r.rate_per_min, CAST(0 AS DOUBLE))
        + coalesce(t.tokens, 0) * CAST({TOKEN_RATE} AS DOUBLE) + coalesce(n.messages, 0) * CAST({MESSAGE_RATE} AS DOUBLE) AS cost
FROM v_calls c LEFT JOIN rt r ON r.provider = c.provider
LEFT JOIN (SELECT call_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_turns GROUP BY call_id) t ON t.call_id = c.call_id
LEFT JOIN (SELECT call_id, count(*) AS messages FROM v_notifications GROUP BY call_id) n ON n.call_id = c.call_id
""", "v_calls", "v_turns", "v_notifications", extra={"rt": RATES_SQL}))(
    lambda spark, sf: (lambda t: RP.cost_per_call(V.calls(t), V.turns(t), V.notifications(t), rates(spark),
                                                  TOKEN_RATE, MESSAGE_RATE))(tables(spark, sf)))


def _quotas(t):
    c = latest(V.configs(t).select("tenant_id", "updated_at", "config_id", "max_concurrent"), "tenant_id",
               "updated_at", tie=["config_id"])
    return c.select("tenant_id", (F.col("max_concurrent") * 10).alias("quota_minutes"))


LATEST_CFG = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC,
  config_id DESC) AS rn FROM v_configs) WHERE rn = 1"""

register("a11_usage", with_views("""
SELECT coalesce(a.tenant_id, b.tenant_id, n.tenant_id) AS tenant_id, coalesce(a.month, b.month, n.month) AS month,
  coalesce(a.minutes, 0.0) AS minutes, coalesce(b.tokens, 0) AS tokens, coalesce(n.messages, 0) AS messages,
  q.max_concurrent * 10 AS quota_minutes, coalesce(a.minutes > q.max_concurrent * 10, false) AS over_quota
FROM (SELECT tenant_id, strftime(started_at, '%Y-%m') AS month, round(sum(coalesce(duration_sec, 0)) / 60.0, 4) AS minutes
      FROM v_calls GROUP BY ALL) a
FULL JOIN (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(tokens) AS BIGINT) AS tokens
      FROM v_turns GROUP BY ALL) b ON a.tenant_id = b.tenant_id AND a.month = b.month
FULL JOIN (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, count(*) AS messages
      FROM v_notifications GROUP BY ALL) n
  ON coalesce(a.tenant_id, b.tenant_id) = n.tenant_id AND coalesce(a.month, b.month) = n.month
LEFT JOIN lc q ON q.tenant_id = coalesce(a.tenant_id, b.tenant_id, n.tenant_id)
""", "v_calls", "v_turns", "v_notifications", "v_configs", extra={"lc": LATEST_CFG}))(
    lambda spark, sf: (lambda t: RP.usage(V.calls(t), V.turns(t), V.notifications(t), _quotas(t)))(tables(spark, sf)))


def _callbacks(t):
    return V.notifications(t).select("tenant_id", "call_id", "channel", F.col("notification_id").alias("event_id"),
                                     F.col("created_at").alias("ts"), "status")


STATE_SQL = """
SELECT tenant_id, call_id, channel,
  first(status ORDER BY rnk DESC, ts DESC, event_id DESC) AS status,
  first(ts ORDER BY rnk DESC, ts DESC, event_id DESC) AS status_at,
  count(*) FILTER (WHERE back) AS steps_back, count(*) AS callbacks
FROM (SELECT *, coalesce(max(rnk) OVER (PARTITION BY tenant_id, call_id, channel ORDER BY ts, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > rnk, false) AS back
      FROM (SELECT tenant_id, call_id, channel, notification_id AS event_id, created_at AS ts, status,
              CASE status WHEN 'failed' THEN 0 WHEN 'queued' THEN 1 WHEN 'sent' THEN 2 WHEN 'delivered' THEN 3
                WHEN 'read' THEN 4 END AS rnk FROM v_notifications))
GROUP BY tenant_id, call_id, channel"""

register("w4_notification_state", with_views(STATE_SQL, "v_notifications"))(
    lambda spark, sf: RP.notification_state(_callbacks(tables(spark, sf)), ["tenant_id", "call_id", "channel"]))

# The status of single messages: each notification is one.
MESSAGE_SQL = STATE_SQL.replace("tenant_id, call_id, channel", "tenant_id, mid, channel").replace(
    "SELECT tenant_id, mid, channel, notification_id AS event_id", "SELECT tenant_id, notification_id AS mid, channel, notification_id AS event_id")

register("a12_delivery_rates", with_views("""
SELECT tenant_id, channel, count(*) AS messages,
  round(count(*) FILTER (WHERE r >= 2) / count(*), 4) AS sent_rate,
  round(count(*) FILTER (WHERE r >= 3) / count(*), 4) AS delivered_rate,
  round(count(*) FILTER (WHERE r >= 4) / count(*), 4) AS read_rate,
  round(count(*) FILTER (WHERE r = 0) / count(*), 4) AS failed_rate
FROM (SELECT *, CASE status WHEN 'failed' THEN 0 WHEN 'queued' THEN 1 WHEN 'sent' THEN 2 WHEN 'delivered' THEN 3
        WHEN 'read' THEN 4 END AS r FROM st) GROUP BY tenant_id, channel
""", "v_notifications", extra={"st": MESSAGE_SQL}))(     # each notification is a message
    lambda spark, sf: RP.delivery_rates(
        RP.notification_state(_callbacks(tables(spark, sf)).withColumnRenamed("event_id", "notification_id")
                              .withColumn("event_id", F.col("notification_id")), ["tenant_id", "notification_id", "channel"])))


register("a13_latency_report", with_views("""
SELECT tenant_id, count(*) AS turns,
  list_sort(list(latency_ms))[CAST(ceil(0.5 * count(*)) AS BIGINT)] AS p50_ms,
  list_sort(list(latency_ms))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95_ms,
  round(count(*) FILTER (WHERE latency_ms > 1500) / count(*), 4) AS over_budget
FROM v_turns GROUP BY tenant_id
""", "v_turns"))(lambda spark, sf: RP.latency_report(V.turns(tables(spark, sf)), 1500))

RUNS_SQL = """SELECT CASE event_type WHEN 'view' THEN 'dashboard' WHEN 'click' THEN 'tool_server'
    WHEN 'purchase' THEN 'call_end' WHEN 'signup' THEN 'ingest' ELSE 'notifier' END AS workflow,
  CAST(user_id % 25 AS INTEGER) AS tenant_id,
  CASE WHEN event_type = 'error' OR value > 90 THEN 'error' ELSE 'success' END AS status, value AS duration_s
FROM events"""


def runs(t):
    """Workflow run log derived from ``events`` (one event = one run)."""
    e = t.events
    wf = F.when(F.col("event_type") == "view", "dashboard").when(F.col("event_type") == "click", "tool_server") \
        .when(F.col("event_type") == "purchase", "call_end").when(F.col("event_type") == "signup", "ingest") \
        .otherwise("notifier")
    return e.select(wf.alias("workflow"), (F.col("user_id") % 25).cast("int").alias("tenant_id"),
                    F.when((F.col("event_type") == "error") | (F.col("value") > 90), "error").otherwise("success")
                    .alias("status"), F.col("value").alias("duration_s"))


register("a14_run_monitor", with_views("""
SELECT workflow, tenant_id, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors,
  round(count(*) FILTER (WHERE status = 'error') / count(*), 4) AS error_rate, round(avg(duration_s), 4) AS avg_duration_s
FROM runs GROUP BY ALL
""", extra={"runs": RUNS_SQL}))(lambda spark, sf: RP.run_monitor(runs(tables(spark, sf))))


def doc_status(t):
    """Q10 inputs derived from the tables: chunks exist for all documents but
    German ones (not processed yet), French ones have only their first two
    chunks (still indexing), and documents labelled toxic failed ingest."""
    d = V.docs(t)
    ch = K.chunk_documents(d.filter(F.col("lang") != "de"))
    ch = ch.join(d.select("doc_id", "lang"), "doc_id").filter((F.col("lang") != "fr") | (F.col("chunk_no") < 2))
    errs = t.labels.filter(F.col("toxic") == 1).select("doc_id")
    return Q.document_status(d, ch, errs)


DOC_STATUS_SQL = """
SELECT d.doc_id, d.tenant_id, coalesce(n.n, 0) AS n_chunks, d.expected,
  CASE WHEN e.doc_id IS NOT NULL THEN 'failed' WHEN coalesce(n.n, 0) = 0 THEN 'pending'
       WHEN coalesce(n.n, 0) < d.expected THEN 'indexing' ELSE 'indexed' END AS status
FROM (SELECT doc_id, tenant_id, CASE WHEN coalesce(length(content), 0) = 0 THEN 0 WHEN length(content) <= 800 THEN 1
        ELSE CAST(ceil((length(content) - 120) / 680) AS INTEGER) END AS expected, lang FROM v_docs) d
LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN 0 WHEN lang = 'fr' THEN least(expected, 2) ELSE expected END AS n
           FROM (SELECT doc_id, lang, CASE WHEN coalesce(length(content), 0) = 0 THEN 0 WHEN length(content) <= 800 THEN 1
                   ELSE CAST(ceil((length(content) - 120) / 680) AS INTEGER) END AS expected FROM v_docs)) n
  ON n.doc_id = d.doc_id AND n.n > 0
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) e ON e.doc_id = d.doc_id"""

register("q10_document_status", with_views(DOC_STATUS_SQL, "v_docs"))(
    lambda spark, sf: doc_status(tables(spark, sf)))

register("a15_index_status", with_views("""
SELECT tenant_id, count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'indexing') AS indexing, count(*) FILTER (WHERE status = 'indexed') AS indexed,
  count(*) FILTER (WHERE status = 'failed') AS failed
FROM ds GROUP BY tenant_id
""", "v_docs", extra={"ds": DOC_STATUS_SQL}))(lambda spark, sf: RP.index_status(doc_status(tables(spark, sf))))

AUDIT_SQL = """SELECT user_id, CASE event_type WHEN 'view' THEN 'open_call' WHEN 'click' THEN 'play_recording'
    WHEN 'purchase' THEN 'export' WHEN 'signup' THEN 'login' ELSE 'login_failed' END AS action, event_id % 50 AS record_id, ts FROM events"""


def audit(t):
    """Access audit rows derived from ``events``."""
    e = t.events
    act = F.when(F.col("event_type") == "view", "open_call").when(F.col("event_type") == "click", "play_recording") \
        .when(F.col("event_type") == "purchase", "export").when(F.col("event_type") == "signup", "login") \
        .otherwise("login_failed")
    return e.select("user_id", act.alias("action"), (F.col("event_id") % 50).alias("record_id"), "ts")


register("a17_access_report", with_views("""
SELECT g.user_id, g.window_start, g.accesses, round(s.mean, 4) AS mean, round(s.sd, 4) AS sd,
  coalesce(g.accesses > s.mean + 2.0 * s.sd, false) AS spike
FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS accesses FROM au GROUP BY ALL) g
JOIN (SELECT user_id, avg(accesses) AS mean, stddev_samp(accesses) AS sd FROM (
        SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS accesses FROM au GROUP BY ALL)
      GROUP BY user_id) s ON s.user_id = g.user_id
""", extra={"au": AUDIT_SQL}))(lambda spark, sf: RP.access_report(audit(tables(spark, sf)), "1 day"))


register("a17_record_access", """
SELECT user_id, CASE event_type WHEN 'view' THEN 'open_call' WHEN 'click' THEN 'play_recording' ELSE 'export' END AS action,
  event_id % 50 AS record_id, count(*) AS accesses, min(ts) AS first_at, max(ts) AS last_at
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL
""")(lambda spark, sf: RP.record_access(audit(tables(spark, sf)), ("open_call", "play_recording", "export")))


def _w1(spark, sf):
    c = V.calls(tables(spark, sf)).select("call_id", "tenant_id", "duration_sec")
    return top_k_per(c.filter(F.col("duration_sec").isNotNull()), "tenant_id",
                     [F.col("duration_sec").desc(), F.col("call_id")], 3, rank_col="rank")


register("w1_top_k_per", with_views("""
SELECT * FROM (SELECT call_id, tenant_id, duration_sec,
  row_number() OVER (PARTITION BY tenant_id ORDER BY duration_sec DESC, call_id) AS rank
  FROM v_calls WHERE duration_sec IS NOT NULL) WHERE rank <= 3
""", "v_calls"))(_w1)


def _w2(spark, sf):
    c = V.configs(tables(spark, sf)).select("tenant_id", "config_id", "template", "updated_at")
    return latest(c, "tenant_id", "updated_at", tie=["config_id"])


register("w2_latest", with_views("""
SELECT tenant_id, config_id, template, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC, config_id DESC) AS rn FROM v_configs)
WHERE rn = 1
""", "v_configs"))(_w2)


def _w3(spark, sf):
    h = RP.recent_history(V.turns(tables(spark, sf)).select("call_id", "turn_no", "role", "content"), 3)
    return h.select("call_id", "turn_no", F.size("history").alias("n_history"),
                    F.array_join("history", " | ").alias("history"))


register("w3_recent_history", with_views("""
SELECT call_id, turn_no, len(h) AS n_history, array_to_string(h, ' | ') AS history FROM (
  SELECT call_id, turn_no, coalesce(list(role || ': ' || content) OVER (PARTITION BY call_id ORDER BY turn_no
    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS h FROM v_turns)
""", "v_turns"))(_w3)


register("w5_double_bookings", with_views("""
SELECT tenant_id, resource_id, scheduled_for, count(*) AS bookings FROM v_bookings GROUP BY ALL HAVING count(*) > 1
""", "v_bookings"))(lambda spark, sf: RP.double_bookings(V.bookings(tables(spark, sf))))


register("w5_outside_slots", with_views("""
SELECT call_id, line_no, part_id, tenant_id, resource_id, scheduled_for FROM v_bookings b
WHERE NOT EXISTS (SELECT 1 FROM v_availability a WHERE NOT a.is_booked AND a.tenant_id = b.tenant_id
                  AND a.resource_id = b.resource_id AND a.slot = b.scheduled_for)
""", "v_bookings", "v_availability"))(
    lambda spark, sf: (lambda t: RP.bookings_outside_slots(
        V.bookings(t).select("call_id", "line_no", "part_id", "tenant_id", "resource_id", "scheduled_for"),
        V.availability(t).filter(~F.col("is_booked"))))(tables(spark, sf)))


CAP_SCALE = 70       # caps about as high as the peaks of the test calls


def _w6(spark, sf):
    t = tables(spark, sf)
    caps = RP.current_caps(V.configs(t)).withColumn("max_concurrent", F.col("max_concurrent") * CAP_SCALE)
    return RP.concurrency(V.calls(t), caps)


register("w6_concurrency", with_views(f"""
SELECT p.tenant_id, p.peak, q.max_concurrent * {CAP_SCALE} AS max_concurrent, coalesce(p.peak > q.max_concurrent * {CAP_SCALE}, false) AS over_cap
FROM (SELECT tenant_id, max(active) AS peak FROM (
        SELECT tenant_id, sum(delta) OVER (PARTITION BY tenant_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS active
        FROM (SELECT tenant_id, t, d, sum(d) AS delta FROM (
                SELECT tenant_id, started_at AS t, 1 AS d FROM v_calls
                UNION ALL SELECT tenant_id, ended_at, -1 FROM v_calls WHERE ended_at IS NOT NULL) GROUP BY ALL))
      GROUP BY tenant_id) p
LEFT JOIN lc q ON q.tenant_id = p.tenant_id
""", "v_calls", "v_configs", extra={"lc": LATEST_CFG}))(_w6)
