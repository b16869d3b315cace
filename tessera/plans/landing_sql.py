"""DuckDB twins of ``tessera.sources.landing`` (request landing tables)."""

from __future__ import annotations


def _landing(fields: dict[str, str], key: str, rid: str, src: str) -> str:
    body = ", ".join(f'"{k}" := {v}' for k, v in fields.items())
    flat = ", ".join(f'CASE WHEN {key} % 3 = 1 THEN {v} END AS "{k}"' for k, v in fields.items())
    return f"SELECT {rid} AS request_id, CASE WHEN {key} % 3 = 0 THEN struct_pack({body}) END AS body, {flat} FROM {src}"


TOOL = _landing({
    "action": """CASE WHEN event_id % 13 = 0 THEN 'transfer' ELSE CASE event_type WHEN 'view' THEN 'search_knowledge'
                 WHEN 'click' THEN 'check_availability' WHEN 'purchase' THEN 'book_appointment'
                 WHEN 'signup' THEN 'capture_lead' WHEN 'error' THEN 'make_reservation' END END""",
    "tenantId": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id % 25 AS VARCHAR) END",
    "callId": "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'call-x' ELSE CAST(user_id AS VARCHAR) END",
    "query": "'question ' || props",
    "name": "'User ' || CAST(user_id AS VARCHAR)",
    "phone": "CASE WHEN event_id % 7 = 0 THEN '' ELSE '+1 (555) ' || lpad(CAST(user_id AS VARCHAR), 4, '0') END",
    "email": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END",
    "datetime": """CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'not a date'
                   ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END""",
    "partySize": "CAST(floor(value) AS INTEGER) % 7",
    "doctor": "'Dr. ' || CAST(user_id % 5 AS VARCHAR)",
    "notes": "props",
}, "event_id", "CAST(event_id AS VARCHAR)", "events")

INGEST = _landing({
    "tenantId": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(tenant_id AS VARCHAR) END",
    "title": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE title END",
    "source": "source",
    "text": "content",
}, "doc_id", "CAST(doc_id AS VARCHAR)", "v_docs")

CALL_END = _landing({
    "tenantId": "CAST(tenant_id AS VARCHAR)",
    "from": "from_number",
    "to": "to_number",
    "provider": "CASE WHEN call_id % 4 = 0 THEN NULL ELSE provider END",
    "recordingUrl": "'https://rec.example.com/' || CAST(call_id AS VARCHAR)",
    "transcript": "CAST(NULL AS VARCHAR)",
    "customerName": "CASE WHEN call_id % 2 = 1 THEN NULL ELSE from_number END",
    "customerPhone": "from_number",
    "customerEmail": "CASE WHEN call_id % 5 = 0 THEN 'c' || CAST(call_id AS VARCHAR) || '@example.com' END",
    "durationSec": "duration_sec",
}, "call_id", "CAST(call_id AS VARCHAR)", "v_calls")

SEARCH = _landing({"tenantId": "CAST(tenant_id AS VARCHAR)", "query": "query_text"},
                  "query_id", "CAST(query_id AS VARCHAR)", "v_eval")


def normalised(src: str, fields: dict[str, tuple[str, str | None]]) -> str:
    """coalesce(body.f, f, default) for each field; ``fields`` maps name to
    (SQL type, SQL literal default or None)."""
    cols = []
    for k, (typ, d) in fields.items():
        dflt = d if d is not None else "NULL"
        cols.append(f'CAST(coalesce(body."{k}", "{k}", {dflt}) AS {typ}) AS "{k}"')
    return f"SELECT request_id, {', '.join(cols)} FROM {src}"


TOOL_FIELDS = {"action": ("VARCHAR", "'search_knowledge'"), "tenantId": ("VARCHAR", None), "callId": ("VARCHAR", "''"),
               "query": ("VARCHAR", "''"), "name": ("VARCHAR", "''"), "phone": ("VARCHAR", "''"),
               "email": ("VARCHAR", "''"), "datetime": ("VARCHAR", "''"), "partySize": ("INTEGER", "0"),
               "doctor": ("VARCHAR", "''"), "notes": ("VARCHAR", "''")}
INGEST_FIELDS = {"tenantId": ("VARCHAR", None), "title": ("VARCHAR", "'Untitled'"), "source": ("VARCHAR", "'dashboard'"),
                 "text": ("VARCHAR", "''")}
CALL_END_FIELDS = {"tenantId": ("VARCHAR", None), "from": ("VARCHAR", "''"), "to": ("VARCHAR", "''"),
                   "provider": ("VARCHAR", "'twilio'"), "recordingUrl": ("VARCHAR", "''"),
                   "transcript": ("VARCHAR", "''"), "customerName": ("VARCHAR", "'there'"),
                   "customerPhone": ("VARCHAR", "''"), "customerEmail": ("VARCHAR", "''"),
                   "durationSec": ("INTEGER", "0")}
SEARCH_FIELDS = {"tenantId": ("VARCHAR", None), "query": ("VARCHAR", "''")}
