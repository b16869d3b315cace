"""Registered queries: streams.

Each query replays table data as a stream: the source rows are written in
one parallel job to a fresh folder under the shared checkpoint directory,
read back with ``readStream``, run with ``availableNow`` into a file sink,
and the sink table is returned. Rows that arrive later (duplicates, changed
documents, the heartbeat that lets time pass) are written to the same folder
afterwards and processed by a second run from the same checkpoint. No row is late, so the
stream's answer equals the batch answer (the oracle SQL).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kb_text as K
from ..operators import requests as R
from ..operators.common import latest
from ..session import shared_path
from ..sources import landing as L
from ..streaming import streams as ST
from .kb_text_q import CHUNKS_SQL, DIGEST_SQL, MOVED_SQL, _moved, digest
from .records_q import BOOKING_SQL, ROUTED
from .registry import V, register, tables, with_views
from .reports_q import LATEST_CFG, STATE_SQL


def _scratch(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"stream-{name}-{uuid.uuid4().hex}")


# Event kinds and actions of the test events (fixed values: event_type -> kind / action).
EVENT_KINDS = {"signup": "call.started", "view": "turn.transcript", "click": "tool.call",
               "purchase": "call.ended", "error": "error"}
EVENT_ACTIONS = {"error": "login_failed", "purchase": "export"}


def _pick(column: str, m: dict[str, str]):
    return F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]), F.col(column))


def with_kind(df: DataFrame) -> DataFrame:
    """The call events of a tenant, as the test events stand for them."""
    return df.withColumn("kind", _pick("event_type", EVENT_KINDS)).withColumn("tenant_id", (F.col("user_id") % 25).cast("int"))


def land(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Adds the rows as files of a stream's source folder, in one parallel write."""
    df.write.mode("append").format(fmt).save(path)
    return path


def table_events(spark, sf) -> DataFrame:
    return tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_source(spark, sf, name) -> str:
    return land(table_events(spark, sf), _scratch(spark, f"src-{name}"))


def _stream(spark, path: str) -> DataFrame:
    return ST.read_events(spark, path, "parquet")


def heartbeat(df: DataFrame, kind: str) -> DataFrame:
    """One event far ahead in event time (user -1): it lets time pass, as in a live feed."""
    return df.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"),
                              F.lit(-1).cast("long").alias("user_id"), F.lit(kind).alias("event_type"),
                              F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))


def _run(spark, stream: DataFrame, name: str, key: list[str], mode: str = "update") -> DataFrame:
    sink = _scratch(spark, f"sink-{name}")
    ST.run_available_now(stream, ST.upsert_log(sink), _scratch(spark, f"ckpt-{name}"), mode)
    return ST.read_latest(spark, sink, key)


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


# M1 -----------------------------------------------------------------------
def _landed(spark, sf) -> tuple[str, str]:
    """Events as JSON lines with malformed ones among them, split by a stream."""
    e = tables(spark, sf).events
    good = e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id",
                    "event_type", "value", "props")
    # malformed copies of the error events (their time is not a time)
    bad = e.filter(F.col("event_type") == "error").select(
        (F.col("event_id") + 1_000_000_000).alias("event_id"), F.lit("not a time").alias("ts"), "user_id",
        "event_type", "value", "props")
    src = land(good.unionByName(bad), _scratch(spark, "src-m1"), "json")
    sink, rejected = _scratch(spark, "sink-m1"), _scratch(spark, "reject-m1")
    ST.run_available_now(ST.read_events(spark, src, "json"), ST.split_events(sink, rejected), _scratch(spark, "ckpt-m1"), "append")
    return sink, rejected


def _m1(spark, sf):
    return spark.read.parquet(_landed(spark, sf)[0]).select("event_id", _ntz("ts").alias("ts"), "user_id", "event_type", "value")


def _m1r(spark, sf):
    line = F.col("_corrupt_record")
    return spark.read.parquet(_landed(spark, sf)[1]).select(
        F.get_json_object(line, "$.event_id").cast("long").alias("event_id"), F.get_json_object(line, "$.ts").alias("raw_ts"))


register("m1_read_events", "SELECT event_id, ts, user_id, event_type, value FROM events")(_m1)
register("m1_rejects", "SELECT event_id + 1000000000 AS event_id, 'not a time' AS raw_ts FROM events WHERE event_type = 'error'")(_m1r)


# M2 -----------------------------------------------------------------------
def _m2(spark, sf):
    """Error events come twice: once more in the same batch, and again in a later one."""
    e = table_events(spark, sf)
    again = e.filter(F.col("event_type") == "error")
    src, sink, ckpt = _scratch(spark, "src-m2"), _scratch(spark, "sink-m2"), _scratch(spark, "ckpt-m2")
    for part in (e.unionByName(again), again):
        land(part, src)
        ST.run_available_now(ST.dedupe_events(_stream(spark, src), "1 hour"), ST.upsert_log(sink), ckpt, "append")
    return spark.read.parquet(sink).select("event_id", _ntz("ts").alias("ts"), "user_id", "event_type")


register("m2_dedupe_events", "SELECT event_id, ts, user_id, event_type FROM events")(_m2)


def _m2_append(spark, sf):
    """The same, and a last batch that repeats all events after a heartbeat has let their state expire."""
    e = table_events(spark, sf)
    again = e.filter(F.col("event_type") == "error")
    src, sink, ckpt = _scratch(spark, "src-m2a"), _scratch(spark, "sink-m2a"), _scratch(spark, "ckpt-m2a")
    for part in (e.unionByName(again), heartbeat(e, "heartbeat"), e):
        land(part, src)
        ST.run_available_now(_stream(spark, src), ST.append_new(sink), ckpt, "append")
    return spark.read.parquet(sink).filter(F.col("event_id") >= 0).select("event_id", _ntz("ts").alias("ts"), "user_id", "event_type")


register("m2_append_new", "SELECT event_id, ts, user_id, event_type FROM events")(_m2_append)


# M3 -----------------------------------------------------------------------
def _m3(spark, sf):
    s = with_kind(_stream(spark, event_source(spark, sf, "m3")))
    k = ST.live_kpis(s, "1 hour", "1 hour").select(
        _ntz("w.start").alias("window_start"), "tenant_id", "calls", "turns", "errors", "events")
    return _run(spark, k, "m3", ["window_start", "tenant_id"])


register("m3_live_kpis", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(user_id % 25 AS INTEGER) AS tenant_id,
  count(*) FILTER (WHERE event_type = 'signup') AS calls, count(*) FILTER (WHERE event_type = 'view') AS turns,
  count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events
FROM events GROUP BY ALL
""")(_m3)


# M4 -----------------------------------------------------------------------
def _m4(spark, sf):
    t = tables(spark, sf)
    cur = latest(V.configs(t).select("tenant_id", "updated_at", "config_id", "max_concurrent"), "tenant_id",
                 "updated_at", tie=["config_id"])
    quotas = cur.select("tenant_id", F.col("max_concurrent").cast("long").alias("quota"))
    s = with_kind(_stream(spark, event_source(spark, sf, "m4")))
    r = ST.rate_limits(s, "1 hour", "30 minutes", "1 hour", quotas).select(
        _ntz("w.start").alias("window_start"), "tenant_id", "requests", "quota", "over_quota")
    return _run(spark, r, "m4", ["window_start", "tenant_id"])


register("m4_rate_limits", with_views("""
SELECT w.window_start, w.tenant_id, w.requests, CAST(q.max_concurrent AS BIGINT) AS quota,
  coalesce(w.requests > q.max_concurrent, false) AS over_quota
FROM (SELECT window_start, tenant_id, count(*) AS requests FROM (
        SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, CAST(user_id % 25 AS INTEGER) AS tenant_id FROM events
        UNION ALL
        SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, CAST(user_id % 25 AS INTEGER) FROM events)
      GROUP BY ALL) w
LEFT JOIN lc q ON q.tenant_id = w.tenant_id
""", "v_configs", extra={"lc": LATEST_CFG}))(_m4)


# M5 -----------------------------------------------------------------------
def _m5(spark, sf):
    """Append mode (session windows are emitted once closed). The heartbeat
    of a later batch moves the watermark past every real session; its own
    session is still open and never emitted."""
    e = table_events(spark, sf)
    src, sink, ckpt = _scratch(spark, "src-m5"), _scratch(spark, "sink-m5"), _scratch(spark, "ckpt-m5")
    for part in (e, heartbeat(e, "heartbeat")):
        land(part, src)
        x = ST.sessions(_stream(spark, src), "30 minutes", "1 hour").select(
            "user_id", _ntz("s.start").alias("session_start"), _ntz("s.end").alias("session_end"), "events")
        with ST.merged_before_shuffle(spark):
            ST.run_available_now(x, ST.upsert_log(sink), ckpt, "append")
    return spark.read.parquet(sink).filter(F.col("user_id") >= 0).drop("batch")


register("m5_sessions", """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
GROUP BY user_id, sid
""")(_m5)


# M6 -----------------------------------------------------------------------
def call_events(t) -> DataFrame:
    """Call events derived from the conversation turns: ``signup`` (call
    started) a second before the first turn, ``view`` (transcript) for each
    caller or agent turn, ``error`` (escalation) for a system turn, and
    ``purchase`` (call ended) a second after the last turn unless the caller
    spoke last (the line dropped: no end event)."""
    tr = V.turns(t)
    per = tr.groupBy("call_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"),
                                    F.max_by("role", "turn_no").alias("last_role"))
    ts = lambda c: F.col(c).cast("timestamp")
    turn_ev = tr.select((F.col("call_id") * 100 + F.col("turn_no")).alias("event_id"), ts("created_at").alias("ts"),
                        F.col("call_id").alias("user_id"),
                        F.when(F.col("role") == "system", "error").otherwise("view").alias("event_type"))
    start = per.select((F.col("call_id") * 100 + 98).alias("event_id"),
                       F.timestamp_add("SECOND", F.lit(-1), F.col("first")).cast("timestamp").alias("ts"),
                       F.col("call_id").alias("user_id"), F.lit("signup").alias("event_type"))
    end = per.filter(F.col("last_role") != "caller").select(
        (F.col("call_id") * 100 + 99).alias("event_id"),
        F.timestamp_add("SECOND", F.lit(1), F.col("last")).cast("timestamp").alias("ts"),
        F.col("call_id").alias("user_id"), F.lit("purchase").alias("event_type"))
    ev = turn_ev.unionByName(start).unionByName(end)
    return ev.select("event_id", "ts", "user_id", "event_type", F.lit(0.0).alias("value"),
                     F.lit(None).cast("string").alias("props"))


def _m6(spark, sf):
    """All call events, then in a later batch a heartbeat far ahead in event
    time (call -1), which lets every open call reach its time-out."""
    ev = call_events(tables(spark, sf))
    src, sink, ckpt = _scratch(spark, "src-m6"), _scratch(spark, "sink-m6"), _scratch(spark, "ckpt-m6")
    states = ST.CallStates(sink, "30 minutes", "10 minutes")
    for part in (ev, heartbeat(ev, "view")):
        land(part, src)
        ST.run_available_now(with_kind(_stream(spark, src)).withColumn("call_id", F.col("user_id")), states, ckpt, "append")
    return states.read(spark).filter(F.col("call_id") >= 0).select("call_id", "state", "turns", _ntz("last_ts").alias("last_ts"))


register("m6_call_states", with_views("""
SELECT call_id, CASE WHEN last_role <> 'caller' THEN 'ended' ELSE 'timed_out' END AS state,
  turns, CASE WHEN last_role <> 'caller' THEN last + INTERVAL 1 SECOND ELSE last END AS last_ts
FROM (SELECT call_id, max(created_at) AS last, arg_max(role, turn_no) AS last_role,
        count(*) FILTER (WHERE role IN ('caller', 'agent')) AS turns
      FROM v_turns GROUP BY call_id)
""", "v_turns"))(_m6)


# M7 -----------------------------------------------------------------------
def _m7(spark, sf):
    n = V.notifications(tables(spark, sf)).select(
        "tenant_id", "call_id", "channel", F.col("notification_id").alias("event_id"),
        F.col("created_at").cast("timestamp").alias("ts"), "status")
    s = spark.readStream.schema(n.schema).parquet(land(n, _scratch(spark, "src-m7")))
    x = ST.fold_status(s, ["tenant_id", "call_id", "channel"], "1 hour")
    return _run(spark, x, "m7", ["tenant_id", "call_id", "channel"])


register("m7_fold_status", with_views("SELECT tenant_id, call_id, channel, status, callbacks FROM st",
                                      "v_notifications", extra={"st": STATE_SQL}))(_m7)


# M8 -----------------------------------------------------------------------
def _m8(spark, sf):
    """All documents, then in a later batch the changed ones (German edited,
    French moved to the next tenant, some texts lost)."""
    old = V.docs(tables(spark, sf))
    cols = ["doc_id", "tenant_id", "content"]
    changed = _moved(old).filter((F.col("lang").isin("de", "fr")) | F.col("content").isNull())
    src, sink, ckpt = _scratch(spark, "src-m8"), _scratch(spark, "sink-m8"), _scratch(spark, "ckpt-m8")

    def chunk(df):
        return K.chunk_documents(df).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_no"))

    def emb(ch):
        return K.hash_embed(ch, ["chunk_id", "doc_id", "tenant_id", "chunk_no", "chunk"], "chunk", 64)

    for part in (old.select(*cols), changed.select(*cols)):
        land(part, src)
        s = spark.readStream.schema(part.schema).parquet(src)
        ST.run_available_now(s, ST.ingest_stream(sink, chunk, emb), ckpt, "append")
    return ST.current_chunks(spark, sink).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(F.size("embedding")).alias("dims"), digest().alias("digest"))


register("m8_ingest_stream", with_views(f"""
SELECT doc_id, count(*) AS n_chunks, 64 AS dims, {DIGEST_SQL} AS digest FROM nch GROUP BY doc_id
""", "v_docs", extra={"mv": MOVED_SQL, "now": "SELECT doc_id, tenant_id, content FROM mv UNION ALL "
                      "SELECT doc_id, tenant_id, content FROM v_docs WHERE lang = 'es'",
                      "nch": CHUNKS_SQL.replace("v_docs", "now")}))(_m8)


# M9 -----------------------------------------------------------------------
M9_TARGETS = {"book_appointment": R.to_booking, "make_reservation": R.to_reservation, "capture_lead": R.to_lead}


def _m9_run(spark, sf) -> str:
    requests = L.tool_requests(tables(spark, sf))
    s = spark.readStream.schema(requests.schema).parquet(land(requests, _scratch(spark, "src-m9")))
    sink = _scratch(spark, "sink-m9")
    ST.run_available_now(s, ST.route_stream(sink, lambda df: R.route_actions(R.normalize_tool_call(df)), M9_TARGETS),
                         _scratch(spark, "ckpt-m9"), "append")
    return sink


def _m9(spark, sf):
    return spark.read.parquet(f"{_m9_run(spark, sf)}/requests").select("request_id", "tenantId", "action", "route")


def _m9b(spark, sf):
    return spark.read.parquet(f"{_m9_run(spark, sf)}/book_appointment").drop("batch")


register("m9_route_stream", with_views('SELECT request_id, "tenantId", action, route FROM rt', extra=ROUTED))(_m9)
register("m9_route_bookings", with_views("SELECT * FROM bk", extra=dict(ROUTED, bk=BOOKING_SQL)))(_m9b)


# M10 ----------------------------------------------------------------------
def _m10(spark, sf):
    s = _stream(spark, event_source(spark, sf, "m10")).withColumn("action", _pick("event_type", EVENT_ACTIONS))
    x = ST.access_spikes(s, "1 hour", 1, "1 hour").select(
        "user_id", "action", _ntz("w.start").alias("window_start"), "attempts")
    return _run(spark, x, "m10", ["user_id", "action", "window_start"])


register("m10_access_spikes", """
SELECT user_id, action, window_start, count(*) AS attempts FROM (
  SELECT user_id, CASE event_type WHEN 'error' THEN 'login_failed' ELSE 'export' END AS action,
    time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events WHERE event_type IN ('error', 'purchase'))
GROUP BY ALL HAVING count(*) > 1
""")(_m10)
