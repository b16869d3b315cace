"""Data quality, privacy and lifecycle: Q1-Q6, Q10.

Checks never drop rows silently: each returns the rows with the rules they
broke (or a count per check), so good and rejected rows can be written to
separate tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kb_text import chunk_count

# The value domains of the schema.
DOMAINS = {
    "sector": ("hospital", "school", "restaurant", "generic"),
    "user_role": ("platform_admin", "tenant_admin", "operator"),
    "provider": ("twilio", "sip", "plivo", "vonage"),
    "turn_role": ("caller", "agent", "system", "tool"),
    "channel": ("email", "whatsapp"),
    "notification_status": ("queued", "sent", "delivered", "read", "failed"),
    "document_status": ("pending", "indexing", "indexed", "failed"),
}


# Q1 -----------------------------------------------------------------------
def check_domains(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """Q1: adds ``failed`` (names of the columns whose value is NULL or outside
    its allowed set) and ``ok``."""
    checks = [F.when(~F.coalesce(F.col(c).isin(*vals), F.lit(False)), F.lit(c)) for c, vals in rules.items()]
    failed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).withColumn("ok", F.size("failed") == 0)


# Q2 -----------------------------------------------------------------------
def check_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Q2: keys that are missing (any part NULL) or used more than once, with
    their row count. A grouped count, combined map-side."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return g.filter(missing | (F.col("rows") > 1)).withColumn(
        "problem", F.when(missing, F.lit("missing_key")).otherwise(F.lit("duplicate_key")))


# Q3 -----------------------------------------------------------------------
def check_refs(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Q3: child rows whose (non-NULL) parent key does not exist."""
    p = parent.select(F.col(pk or fk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")


# Q4 -----------------------------------------------------------------------
def audit_isolation(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Q4: rows whose tenant differs from their parent record's tenant
    (a booking of another tenant's call, a turn of another tenant's call).
    Returns one row: checked rows and mismatches."""
    p = parent.select(key, F.col("tenant_id").alias("_pt"))
    j = child.select(key, "tenant_id").join(p, key, "inner")
    return j.agg(F.count(F.lit(1)).alias("checked"),
                 F.count_if(F.col("tenant_id") != F.col("_pt")).alias("mismatches")) \
        .select(F.lit(name).alias("check"), "checked", "mismatches")


# Q5 -----------------------------------------------------------------------
# What counts as an e-mail address and as a phone number.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """Q5: e-mail addresses, then phone numbers, masked in the whole text,
    with the number of each found."""
    t = F.col(text_col)
    # the e-mail-masked text is a column of its own, so the optimiser keeps
    # it computed once for the phone count and the phone masking
    out = df.withColumn("n_emails", F.regexp_count(t, F.lit(EMAIL_PATTERN))) \
            .withColumn("_no_mail", F.regexp_replace(t, EMAIL_PATTERN, "[email]"))
    return out.withColumn("n_phones", F.regexp_count("_no_mail", F.lit(PHONE_PATTERN))) \
              .withColumn(text_col, F.regexp_replace("_no_mail", PHONE_PATTERN, "[phone]")).drop("_no_mail")


# Q6 -----------------------------------------------------------------------
def pseudonymise(df: DataFrame, cols: list[str], salt: str) -> DataFrame:
    """Q6: keyed SHA-256 of contact fields (salt + value), so equal values
    still join; NULL stays NULL."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c)), 256)))
    return out


# Q10 ----------------------------------------------------------------------
def document_status(docs: DataFrame, chunks: DataFrame, errors: DataFrame, size: int = 800,
                    overlap: int = 120, text_col: str = "content") -> DataFrame:
    """Q10: failed (an ingest error), pending (no chunk yet), indexing (fewer
    chunks than the text needs), indexed."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    e = errors.select("doc_id", F.lit(True).alias("_err")).distinct()
    d = docs.select("doc_id", "tenant_id", chunk_count(F.coalesce(F.length(text_col), F.lit(0)), size, overlap)
                    .alias("expected"))
    j = d.join(n, "doc_id", "left").join(e, "doc_id", "left")
    nc = F.coalesce("n_chunks", F.lit(0))
    status = (F.when(F.col("_err"), F.lit("failed")).when(nc == 0, F.lit("pending"))
               .when(nc < F.col("expected"), F.lit("indexing")).otherwise(F.lit("indexed")))
    return j.select("doc_id", "tenant_id", nc.alias("n_chunks"), "expected", status.alias("status"))
