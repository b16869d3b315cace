"""Request landing tables derived from the driver tables.

The reference receives requests one at a time; here whole batches of them
are derived from the test tables so every normalisation rule is exercised:
fields under ``body``, at the top level, or missing (defaults apply), blank
and malformed values. DuckDB twins live in ``tessera.plans.landing_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables
from .views import _case, calls, docs, eval_questions

EVENT_ACTIONS = {"view": "search_knowledge", "click": "check_availability", "purchase": "book_appointment",
                 "signup": "capture_lead", "error": "make_reservation"}


def _landing(fields: dict[str, Column], key: Column, request_id: Column, src: DataFrame) -> DataFrame:
    body = F.when(key % 3 == 0, F.struct(*[v.alias(k) for k, v in fields.items()]))
    flat = [F.when(key % 3 == 1, v).alias(k) for k, v in fields.items()]
    return src.select(request_id.alias("request_id"), body.alias("body"), *flat)


def tool_requests(t: Tables) -> DataFrame:
    e = t.events
    eid, uid = F.col("event_id"), F.col("user_id")
    fields = {
        "action": F.when(eid % 13 == 0, F.lit("transfer")).otherwise(_case(F.col("event_type"), EVENT_ACTIONS)),
        "tenantId": F.when(eid % 17 == 0, F.lit(None).cast("string")).otherwise((uid % 25).cast("string")),
        "callId": F.when(eid % 5 == 0, F.lit("")).when(eid % 19 == 0, F.lit("call-x"))
                   .otherwise(uid.cast("string")),
        "query": F.concat(F.lit("question "), F.col("props")),
        "name": F.concat(F.lit("User "), uid.cast("string")),
        "phone": F.when(eid % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit("+1 (555) "), F.lpad(uid.cast("string"), 4, "0"))),
        "email": F.when(eid % 4 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit("user"), uid.cast("string"), F.lit("@example.com"))),
        "datetime": F.when(eid % 6 == 0, F.lit("")).when(eid % 11 == 0, F.lit("not a date"))
                     .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        "partySize": (F.floor("value").cast("int") % 7),
        "doctor": F.concat(F.lit("Dr. "), (uid % 5).cast("string")),
        "notes": F.col("props"),
    }
    return _landing(fields, eid, eid.cast("string"), e)


def ingest_requests(t: Tables) -> DataFrame:
    d = docs(t)
    k = F.col("doc_id")
    fields = {
        "tenantId": F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("tenant_id").cast("string")),
        "title": F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("title")),
        "source": F.col("source"),
        "text": F.col("content"),
    }
    return _landing(fields, k, k.cast("string"), d)


def call_end_requests(t: Tables) -> DataFrame:
    c = calls(t)
    k = F.col("call_id")
    fields = {
        "tenantId": F.col("tenant_id").cast("string"),
        "from": F.col("from_number"),
        "to": F.col("to_number"),
        "provider": F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("provider")),
        "recordingUrl": F.concat(F.lit("https://rec.example.com/"), k.cast("string")),
        "transcript": F.lit(None).cast("string"),
        "customerName": F.when(k % 2 == 1, F.lit(None).cast("string")).otherwise(F.col("from_number")),
        "customerPhone": F.col("from_number"),
        "customerEmail": F.when(k % 5 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))),
        "durationSec": F.col("duration_sec"),
    }
    return _landing(fields, k, k.cast("string"), c)


def search_requests(t: Tables) -> DataFrame:
    q = eval_questions(t)
    k = F.col("query_id")
    fields = {"tenantId": F.col("tenant_id").cast("string"), "query": F.col("query_text")}
    return _landing(fields, k, k.cast("string"), q)
