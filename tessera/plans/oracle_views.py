"""DuckDB definitions of the record views in ``tessera.sources.views``.

Used only by ``oracle_sql()``: each oracle statement is prefixed with the
CTEs it needs. Keep every expression in step with the Spark view.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "v_tenants": """
SELECT n_nationkey AS tenant_id, n_name AS name,
  CASE n_regionkey % 4 WHEN 0 THEN 'hospital' WHEN 1 THEN 'school' WHEN 2 THEN 'restaurant' ELSE 'generic' END AS sector,
  n_regionkey AS region_id,
  CASE n_regionkey WHEN 0 THEN 'Africa/Lagos' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata'
    WHEN 3 THEN 'Europe/Berlin' WHEN 4 THEN 'Asia/Dubai' END AS timezone
FROM nation""",
    "v_calls": """
SELECT o_orderkey AS call_id, c_nationkey AS tenant_id,
  '+1' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS from_number,
  '+1800' || lpad(CAST(c_nationkey AS VARCHAR), 7, '0') AS to_number,
  CASE c_nationkey % 4 WHEN 0 THEN 'twilio' WHEN 1 THEN 'exotel' WHEN 2 THEN 'plivo' ELSE 'vonage' END AS provider,
  CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INTEGER) END AS duration_sec,
  o_orderpriority = '1-URGENT' AS escalated,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'booking' WHEN '3-MEDIUM' THEN 'inquiry'
    WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'complaint' END AS intent,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'unresolved' END AS outcome,
  CASE o_custkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
  o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
  o_orderdate + to_seconds(o_orderkey % 86400)
    + to_seconds(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END) AS ended_at,
  CASE WHEN o_orderstatus = 'F' THEN 'calls/' || CAST(o_orderkey AS VARCHAR) || '.ogg' END AS recording_url,
  CASE WHEN o_orderstatus <> 'P' THEN 'order ' || CAST(o_orderkey AS VARCHAR) || ', ' || lower(o_orderpriority) END AS summary
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_bookings": """
SELECT l_orderkey AS call_id, CAST(l_suppkey % 25 AS INTEGER) AS tenant_id,
  CASE l_returnflag WHEN 'A' THEN 'appointment' WHEN 'R' THEN 'reservation' ELSE 'visit' END AS type,
  'Guest ' || CAST(l_partkey AS VARCHAR) AS customer_name,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE '+1' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') END AS customer_phone,
  CASE WHEN l_linenumber % 2 = 0 THEN 'guest' || CAST(l_partkey AS VARCHAR) || '@example.com' END AS customer_email,
  CAST(round(l_quantity) AS INTEGER) AS party_size,
  l_shipdate AS scheduled_for,
  l_shipdate - to_days(l_linenumber) AS created_at,
  l_suppkey AS resource_id, l_linenumber AS line_no, l_partkey AS part_id,
  CASE l_linestatus WHEN 'F' THEN 'confirmed' ELSE 'pending' END AS status
FROM lineitem""",
    "v_leads": """
SELECT c_custkey AS lead_id, c_nationkey AS tenant_id, c_name AS name,
  '+1' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone,
  lower(replace(c_name, '#', '')) || '@example.com' AS email,
  lower(c_mktsegment) AS status
FROM customer""",
    "v_availability": """
SELECT CAST(l_suppkey % 25 AS INTEGER) AS tenant_id, l_suppkey AS resource_id,
  'Resource ' || CAST(l_suppkey AS VARCHAR) AS resource_name,
  l_shipdate AS slot, l_linestatus = 'F' AS is_booked, l_orderkey AS order_key, l_linenumber AS line_no
FROM lineitem""",
    "v_notifications": """
SELECT event_id AS notification_id, user_id AS call_id, CAST(user_id % 25 AS INTEGER) AS tenant_id,
  CASE WHEN event_id % 2 = 0 THEN 'whatsapp' ELSE 'email' END AS channel,
  CASE WHEN event_id % 2 = 0 THEN '+1' || lpad(CAST(user_id AS VARCHAR), 10, '0')
       ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END AS recipient,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'sent' WHEN 'click' THEN 'delivered'
    WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'failed' END AS status,
  CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE 'msg-' || CAST(event_id AS VARCHAR) END AS provider_message_id,
  CASE WHEN event_type = 'error' THEN 'provider rejected' END AS error,
  CAST(event_id % 8 AS INTEGER) AS attempts,
  ts AS created_at, value, props
FROM events""",
    "v_turns": """
SELECT conv_id AS call_id, CAST(conv_id % 10 AS INTEGER) AS tenant_id, turn AS turn_no,
  CASE role WHEN 'user' THEN 'caller' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS role,
  text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 20) AS created_at,
  CAST((length(text) * 7) % 3000 + 200 AS INTEGER) AS latency_ms,
  CAST(len(string_split(text, ' ')) AS INTEGER) AS tokens
FROM conversations""",
    "v_docs": """
SELECT doc_id, CAST(substr(source, 4, 10) AS INTEGER) AS tenant_id,
  split_part(text, chr(10), 1) AS title, source, lang, text AS content, n_chars
FROM documents""",
    "v_chunks": """
SELECT vec_id AS chunk_id, label AS tenant_id, embedding FROM embeddings""",
    "v_eval": """
SELECT item_id AS query_id, CAST(item_id % 20 AS INTEGER) AS tenant_id, text AS query_text FROM benchmark""",
    "v_configs": """
SELECT s_suppkey AS config_id, s_nationkey AS tenant_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'hospital' WHEN 1 THEN 'school' WHEN 2 THEN 'restaurant' ELSE 'generic' END AS template,
  'You are the assistant of ' || s_name || '.' AS system_prompt,
  'Welcome to {{tenant}}, this is {{agent}}. How can I help?' AS greeting,
  s_name AS agent_name,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey * 3600) AS updated_at,
  CAST(s_suppkey % 3 + 8 AS INTEGER) AS open_hour,
  CAST(s_suppkey % 4 + 17 AS INTEGER) AS close_hour,
  s_suppkey % 2 = 0 AS email_enabled,
  s_suppkey % 3 <> 0 AS whatsapp_enabled,
  CAST(s_suppkey % 5 + 1 AS INTEGER) AS max_concurrent,
  CAST((s_suppkey % 12) * 30 + 30 AS INTEGER) AS retention_days
FROM supplier""",
}

# Views that use other views.
DEPENDS = {}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views (and any extra CTEs, in order)."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v.strip()})")
    if not parts:
        return sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
