"""Request handling: landing source (S1), normalisation (P1-P4), routing (F2)
and the target rows of the routes (P5).

A request may carry a field under ``body`` or at the top level; the first
non-null one wins, else a default (the ``??`` rule). Everything is a
projection, so a batch of any size is one map-only stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import blank_cast, blank_cast_failed, details, falsy_or

_S = T.StringType()
# The fields of each request kind and their defaults
# (field: (type, default)); the tenant has no default here (see README).
TOOL_FIELDS = {
    "action": (_S, "search_knowledge"), "tenantId": (_S, None), "callId": (_S, ""), "query": (_S, ""),
    "name": (_S, ""), "phone": (_S, ""), "email": (_S, ""), "datetime": (_S, ""),
    "partySize": (T.IntegerType(), 0), "doctor": (_S, ""), "notes": (_S, ""),
}
INGEST_FIELDS = {"tenantId": (_S, None), "title": (_S, "Untitled"), "source": (_S, "dashboard"), "text": (_S, "")}
CALL_END_FIELDS = {
    "tenantId": (_S, None), "from": (_S, ""), "to": (_S, ""), "provider": (_S, "twilio"),
    "recordingUrl": (_S, ""), "transcript": (_S, ""), "customerName": (_S, "there"),
    "customerPhone": (_S, ""), "customerEmail": (_S, ""), "durationSec": (T.IntegerType(), 0),
}
SEARCH_FIELDS = {"tenantId": (_S, None), "query": (_S, "")}
KINDS = {"tool": TOOL_FIELDS, "ingest": INGEST_FIELDS, "call_end": CALL_END_FIELDS, "search": SEARCH_FIELDS}


def request_schema(fields: dict) -> T.StructType:
    flat = [T.StructField(k, t) for k, (t, _) in fields.items()]
    return T.StructType([T.StructField("request_id", T.StringType()), T.StructField("body", T.StructType(flat))] + flat)


# S1 -----------------------------------------------------------------------
def read_requests(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Landed request files (JSON lines) with the explicit schema of the
    kind; lines that do not parse land in ``_corrupt_record``."""
    schema = request_schema(KINDS[kind]).add("_corrupt_record", T.StringType())
    r = (spark.readStream if stream else spark.read).schema(schema).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    return r.json(path)


# P1-P4 ----------------------------------------------------------------------
def _normalise(df: DataFrame, fields: dict, default_tenant: str | None) -> DataFrame:
    cols: list[Column] = []
    for k, (t, d) in fields.items():
        parts = []
        if "body" in df.columns:
            parts.append(F.col("body").getField(k))
        if k in df.columns:
            parts.append(F.col(k))
        if k == "tenantId":
            d = default_tenant
        c = F.coalesce(*parts, F.lit(d)) if parts else F.lit(d)
        cols.append(c.cast(t).alias(k))
    keep = [F.col("request_id")] if "request_id" in df.columns else []
    return df.select(*keep, *cols)


def normalize_ingest(df: DataFrame, default_tenant: str | None = None) -> DataFrame:
    """Tenant, title, source, text of an ingest request; other fields dropped."""
    return _normalise(df, INGEST_FIELDS, default_tenant)


def normalize_tool_call(df: DataFrame, default_tenant: str | None = None) -> DataFrame:
    """The 11 fields of a tool call (``partySize`` numeric)."""
    return _normalise(df, TOOL_FIELDS, default_tenant)


def normalize_call_end(df: DataFrame, default_tenant: str | None = None) -> DataFrame:
    """The 10 fields of a call-end report; provider defaults to twilio and
    the customer name to "there"."""
    return _normalise(df, CALL_END_FIELDS, default_tenant)


def normalize_search(df: DataFrame, default_tenant: str | None = None) -> DataFrame:
    """Tenant and query of a search request."""
    return _normalise(df, SEARCH_FIELDS, default_tenant)


# F2 -----------------------------------------------------------------------
# The five routes, matched case-sensitively; anything else goes
# to the fallback route.
ROUTES = ("search_knowledge", "check_availability", "book_appointment", "make_reservation", "capture_lead")
FALLBACK_ROUTE = "transfer_or_unknown"


def route_actions(df: DataFrame) -> DataFrame:
    """adds ``route``: the action when it is one of the five routes
    (exact, case-sensitive), else the fallback."""
    a = F.col("action")
    return df.withColumn("route", F.when(a.isin(*ROUTES), a).otherwise(F.lit(FALLBACK_ROUTE)))


def split_routes(df: DataFrame) -> dict[str, DataFrame]:
    """One filtered DataFrame per route (the caller caches ``df`` if it
    will run all of them)."""
    r = route_actions(df)
    return {name: r.filter(F.col("route") == name) for name in (*ROUTES, FALLBACK_ROUTE)}


# P5 -----------------------------------------------------------------------
def _common(df: DataFrame) -> list[Column]:
    return [F.col("tenantId").alias("tenant_id"),
            blank_cast(F.col("callId"), "bigint").alias("call_id"),
            blank_cast_failed(F.col("callId"), "bigint").alias("bad_call_id")]


def to_booking(df: DataFrame) -> DataFrame:
    """P5: appointment row: blank call id and date become NULL, typed casts
    (text that does not parse is NULL and flagged), JSON details."""
    return df.select(
        "request_id", *_common(df), F.lit("appointment").alias("type"),
        F.col("name").alias("customer_name"), F.col("phone").alias("customer_phone"),
        F.col("email").alias("customer_email"), F.lit(None).cast("int").alias("party_size"),
        blank_cast(F.col("datetime"), "timestamp_ntz").alias("scheduled_for"),
        blank_cast_failed(F.col("datetime"), "timestamp_ntz").alias("bad_datetime"),
        details(doctor="doctor", notes="notes").alias("details"))


def to_reservation(df: DataFrame) -> DataFrame:
    """P5: reservation row; a party size of 0 (or missing) becomes NULL."""
    return df.select(
        "request_id", *_common(df), F.lit("reservation").alias("type"),
        F.col("name").alias("customer_name"), F.col("phone").alias("customer_phone"),
        F.lit(None).cast("string").alias("customer_email"),
        falsy_or(F.col("partySize"), None, numeric=True).cast("int").alias("party_size"),
        blank_cast(F.col("datetime"), "timestamp_ntz").alias("scheduled_for"),
        blank_cast_failed(F.col("datetime"), "timestamp_ntz").alias("bad_datetime"),
        details(notes="notes").alias("details"))


def to_lead(df: DataFrame) -> DataFrame:
    """P5: lead row with the query and notes as JSON data."""
    return df.select(
        "request_id", *_common(df), F.col("name"), F.col("phone"), F.col("email"),
        details(query="query", notes="notes").alias("data"))
