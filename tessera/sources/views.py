"""Record views over the driver tables.

The driver tables are TPC-H-like, not phone-service data. These views give
them the record shapes the operators work on (tenants, calls, bookings,
leads, availability, notifications, turns, documents, chunks, pages).
Every column is arithmetic on an existing one, so the same view can be
written in DuckDB SQL for the oracle (``tessera.plans.oracle_views``);
both definitions must stay in step.

All views are plain projections/joins: Catalyst prunes unused columns and
pushes filters through them into the Parquet scans.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ts_lit
from .tables import Tables

# Fixed values shared with the oracle views (must stay equal there).
SECTORS = ("hospital", "school", "restaurant", "generic")   # by n_regionkey % 4
REGION_ZONES = ("Africa/Lagos", "America/New_York", "Asia/Kolkata", "Europe/Berlin", "Asia/Dubai")
PROVIDERS = ("twilio", "exotel", "plivo", "vonage")          # by c_nationkey % 4
AS_OF = _dt.datetime(1998, 6, 1)                            # "now" for availability / dashboard
TURNS_EPOCH = _dt.datetime(2024, 1, 1)


def _case(col: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _phone(col: Column) -> Column:
    return F.concat(F.lit("+1"), F.lpad(col.cast("string"), 10, "0"))


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)


def tenants(t: Tables) -> DataFrame:
    n = t.nation
    return n.select(
        F.col("n_nationkey").alias("tenant_id"),
        F.col("n_name").alias("name"),
        _case(F.col("n_regionkey") % 4, dict(enumerate(SECTORS))).alias("sector"),
        F.col("n_regionkey").alias("region_id"),
        _case(F.col("n_regionkey"), dict(enumerate(REGION_ZONES))).alias("timezone"),
    )


def calls(t: Tables) -> DataFrame:
    o = t.orders
    c = t.customer.select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    dur = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("int")).otherwise(
        F.floor(F.col("o_totalprice") / 1000).cast("int"))
    started = _plus_seconds(F.col("o_orderdate"), F.col("o_orderkey") % 86400)
    return j.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("c_nationkey").alias("tenant_id"),
        _phone(F.col("o_custkey")).alias("from_number"),
        F.concat(F.lit("+1800"), F.lpad(F.col("c_nationkey").cast("string"), 7, "0")).alias("to_number"),
        _case(F.col("c_nationkey") % 4, dict(enumerate(PROVIDERS))).alias("provider"),
        _case(F.col("o_orderstatus"), {"P": "active", "F": "completed"}, "failed").alias("status"),
        dur.alias("duration_sec"),
        (F.col("o_orderpriority") == "1-URGENT").alias("escalated"),
        _case(F.col("o_orderpriority"), {"1-URGENT": "emergency", "2-HIGH": "booking",
                                         "3-MEDIUM": "inquiry", "4-NOT SPECIFIED": "other"},
              "complaint").alias("intent"),
        _case(F.col("o_orderstatus"), {"F": "resolved", "O": "unresolved"}).alias("outcome"),
        _case(F.col("o_custkey") % 3, {0: "positive", 1: "neutral"}, "negative").alias("sentiment"),
        started.alias("started_at"),
        _plus_seconds(started, dur).alias("ended_at"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("calls/"), F.col("o_orderkey").cast("string"), F.lit(".ogg")))
         .alias("recording_url"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(", "),
                                                       F.lower("o_orderpriority"))).alias("summary"),
    )


def bookings(t: Tables) -> DataFrame:
    l = t.lineitem
    return l.select(
        F.col("l_orderkey").alias("call_id"),
        (F.col("l_suppkey") % 25).cast("int").alias("tenant_id"),
        _case(F.col("l_returnflag"), {"A": "appointment", "R": "reservation"}, "visit").alias("type"),
        F.concat(F.lit("Guest "), F.col("l_partkey").cast("string")).alias("customer_name"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(_phone(F.col("l_partkey"))).alias("customer_phone"),
        F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit("guest"), F.col("l_partkey").cast("string"), F.lit("@example.com")))
         .alias("customer_email"),
        F.round(F.col("l_quantity")).cast("int").alias("party_size"),
        F.col("l_shipdate").alias("scheduled_for"),
        F.timestamp_add("DAY", -F.col("l_linenumber"), F.col("l_shipdate")).alias("created_at"),
        F.col("l_suppkey").alias("resource_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        _case(F.col("l_linestatus"), {"F": "confirmed"}, "pending").alias("status"),
    )


def leads(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("lead_id"),
        F.col("c_nationkey").alias("tenant_id"),
        F.col("c_name").alias("name"),
        _phone(F.col("c_custkey")).alias("phone"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("email"),
        F.lower(F.col("c_mktsegment")).alias("status"),
    )


def availability(t: Tables) -> DataFrame:
    l = t.lineitem
    return l.select(
        (F.col("l_suppkey") % 25).cast("int").alias("tenant_id"),
        F.col("l_suppkey").alias("resource_id"),
        F.concat(F.lit("Resource "), F.col("l_suppkey").cast("string")).alias("resource_name"),
        F.col("l_shipdate").alias("slot"),
        (F.col("l_linestatus") == "F").alias("is_booked"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
    )


NOTIFY_STATUS = {"signup": "queued", "view": "sent", "click": "delivered", "purchase": "read", "error": "failed"}


def notifications(t: Tables) -> DataFrame:
    e = t.events
    channel = F.when(F.col("event_id") % 2 == 0, F.lit("whatsapp")).otherwise(F.lit("email"))
    return e.select(
        F.col("event_id").alias("notification_id"),
        F.col("user_id").alias("call_id"),
        (F.col("user_id") % 25).cast("int").alias("tenant_id"),
        channel.alias("channel"),
        F.when(F.col("event_id") % 2 == 0, _phone(F.col("user_id")))
         .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")))
         .alias("recipient"),
        _case(F.col("event_type"), NOTIFY_STATUS).alias("status"),
        F.when(F.col("event_type").isin("signup", "error"), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("msg-"), F.col("event_id").cast("string"))).alias("provider_message_id"),
        F.when(F.col("event_type") == "error", F.lit("provider rejected")).alias("error"),
        (F.col("event_id") % 8).cast("int").alias("attempts"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("value"),
        F.col("props").alias("props"),
    )


ROLES = {"user": "caller", "assistant": "agent"}


def turns(t: Tables) -> DataFrame:
    c = t.conversations
    created = _plus_seconds(ts_lit(TURNS_EPOCH),
                            F.col("conv_id") * 3600 + F.col("turn") * 20)
    return c.select(
        F.col("conv_id").alias("call_id"),
        (F.col("conv_id") % 10).cast("int").alias("tenant_id"),
        F.col("turn").alias("turn_no"),
        _case(F.col("role"), ROLES, "system").alias("role"),
        F.col("text").alias("content"),
        created.alias("created_at"),
        ((F.length("text") * 7) % 3000 + 200).cast("int").alias("latency_ms"),
        F.size(F.split(F.col("text"), " ")).cast("int").alias("tokens"),
    )


def docs(t: Tables) -> DataFrame:
    d = t.documents
    return d.select(
        F.col("doc_id"),
        F.substring(F.col("source"), 4, 10).cast("int").alias("tenant_id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("source"),
        F.col("lang"),
        F.col("text").alias("content"),
        F.col("n_chars"),
    )


def eval_questions(t: Tables) -> DataFrame:
    """Evaluation questions from ``benchmark``, each assigned to one of the
    20 document tenants."""
    b = t.benchmark
    return b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).cast("int").alias("tenant_id"),
                    F.col("text").alias("query_text"))


def chunks(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").alias("tenant_id"),
        F.col("embedding"),
    )


def configs(t: Tables) -> DataFrame:
    """Agent configs (one or more per tenant, or none) from ``supplier``."""
    s = t.supplier
    k = F.col("s_suppkey")
    return s.select(
        k.alias("config_id"),
        F.col("s_nationkey").alias("tenant_id"),
        _case(k % 4, dict(enumerate(SECTORS))).alias("template"),
        F.concat(F.lit("You are the assistant of "), F.col("s_name"), F.lit(".")).alias("system_prompt"),
        F.lit("Welcome to {{tenant}}, this is {{agent}}. How can I help?").alias("greeting"),
        F.col("s_name").alias("agent_name"),
        _plus_seconds(ts_lit(TURNS_EPOCH), k * 3600).alias("updated_at"),
        (k % 3 + 8).cast("int").alias("open_hour"),
        (k % 4 + 17).cast("int").alias("close_hour"),
        (k % 2 == 0).alias("email_enabled"),
        (k % 3 != 0).alias("whatsapp_enabled"),
        (k % 5 + 1).cast("int").alias("max_concurrent"),
        ((k % 12) * 30 + 30).cast("int").alias("retention_days"),
    )
