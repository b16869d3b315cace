"""Record keeping: scan (S4), append with key (S5), keyed update (S6),
upsert (S7), insert-if-absent with defaults (S8), month-partitioned sink
(S9), retention (S10), cascading delete (S11), tenant export (S12).

No table is changed in place. Writes go to a new folder (a snapshot) that
the caller switches to; keys are content hashes, so a retried or replayed
batch produces the same rows and the same keys (idempotent).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import content_key, ts_lit
from .common import latest, lookup


# S4 -----------------------------------------------------------------------
def scan(df: DataFrame, cols: list[str], tenant=None) -> DataFrame:
    """Named columns of one tenant (or all); the filter and the column
    list reach the Parquet scan."""
    out = df if tenant is None else df.filter(F.col("tenant_id") == F.lit(tenant))
    return out.select(*cols)


# S5 -----------------------------------------------------------------------
def append(rows: DataFrame, key_cols: list[str], defaults: dict | None = None, path: str | None = None,
           id_col: str = "id") -> DataFrame:
    """Rows with a deterministic id (SHA-256 of ``key_cols``) and declared
    column defaults; written in append mode when ``path`` is given. Returns the
    keyed rows (the ``RETURNING id, status`` of the reference)."""
    out = rows.withColumn(id_col, content_key(*key_cols))
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    if path:
        out.write.mode("append").parquet(path)
    return out


def one_per_key(rows: DataFrame, keys: list[str], ts_col: str | None = None) -> DataFrame:
    """One row per key of a batch of changes: the newest by ``ts_col`` when
    given, else (and among equal times) the one with the largest values."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    order = F.struct(*([F.col(ts_col)] if ts_col else []), *[F.to_json(F.struct(F.col(c))) for c in rest])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")) \
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# S6 -----------------------------------------------------------------------
def update_by_key(base: DataFrame, changes: DataFrame, key, cols: list[str], ts_col: str | None = None) -> DataFrame:
    """Sets ``cols`` from ``changes`` on the base rows with the same key;
    other rows and columns are unchanged. When a batch repeats a key, one of
    its rows counts (``one_per_key``: the newest by ``ts_col``)."""
    keys = [key] if isinstance(key, str) else list(key)
    changes = one_per_key(changes.select(*dict.fromkeys([*keys, *cols, *([ts_col] if ts_col else [])])), keys, ts_col)
    ch = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = base.join(ch, keys, "left")
    out = j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                     else F.col(c) for c in base.columns])
    return out


# S7 -----------------------------------------------------------------------
def upsert(base: DataFrame, incoming: DataFrame, key, cols: list[str], id_col: str = "config_id",
           ts_col: str | None = "updated_at", as_of: dt.datetime | None = None) -> DataFrame:
    """Every base row whose key has an incoming row gets the incoming
    values (all of them, as the reference updates every row of the tenant);
    keys with no base row are inserted with a content-hash id. When the batch
    repeats a key, one of its rows counts (``one_per_key``). Adds ``action`` =
    updated / inserted / unchanged."""
    keys = [key] if isinstance(key, str) else list(key)
    incoming = one_per_key(incoming, keys, ts_col if ts_col in incoming.columns else None)
    inc = incoming.select(*keys, *[F.col(c).alias(f"_in_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = base.join(inc, keys, "left")
    upd = []
    for c in base.columns:
        if c in cols:
            upd.append(F.when(F.col("_hit"), F.col(f"_in_{c}")).otherwise(F.col(c)).alias(c))
        elif ts_col and c == ts_col and as_of is not None:
            upd.append(F.when(F.col("_hit"), ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            upd.append(F.col(c))
    updated = j.select(*upd, F.when(F.col("_hit"), F.lit("updated")).otherwise(F.lit("unchanged")).alias("action"))
    new = incoming.join(base.select(*keys), keys, "left_anti")
    ins_cols = []
    for c in base.columns:
        if c in keys or c in cols:
            ins_cols.append(F.col(c))
        elif c == id_col:
            ins_cols.append(content_key(*keys).alias(c))
        elif ts_col and c == ts_col and as_of is not None:
            ins_cols.append(ts_lit(as_of).alias(c))
        else:
            ins_cols.append(F.lit(None).cast(base.schema[c].dataType).alias(c))
    inserted = new.select(*ins_cols, F.lit("inserted").alias("action"))
    if id_col in base.columns and base.schema[id_col].dataType.simpleString() != "string":
        updated = updated.withColumn(id_col, F.col(id_col).cast("string"))
    return updated.unionByName(inserted)


# S8 -----------------------------------------------------------------------
def insert_if_absent(base: DataFrame, rows: DataFrame, key, defaults: dict) -> DataFrame:
    """Rows whose key is not yet in ``base``, one per key (the batch may
    repeat a key; the row with the smallest remaining values is kept), with
    declared defaults filled; returns the rows to insert."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    # one row per key, chosen deterministically (smallest remaining values)
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")) \
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else rows.select(*keys).distinct()
    new = first.join(base.select(*keys), keys, "left_anti")
    for c, v in defaults.items():
        new = new.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in new.columns else F.lit(v))
    return new


# S9 -----------------------------------------------------------------------
def write_by_month(df: DataFrame, path: str, ts_col: str) -> None:
    """Parquet folders by ``month=yyyy-MM``; readers that filter on month
    prune whole folders. The ``rebalance`` hint gathers a month's rows into few
    files of the advisory size and splits a large month over many tasks."""
    (df.withColumn("month", F.date_format(ts_col, "yyyy-MM")).hint("rebalance", "month")
       .write.mode("overwrite").partitionBy("month").parquet(path))


def read_months(spark, path: str, first: str, last: str) -> DataFrame:
    """Reads months ``first``..``last`` (inclusive, ``yyyy-MM``): partition
    pruning keeps the other folders unread."""
    df = spark.read.parquet(path)
    return df.filter((F.col("month") >= first) & (F.col("month") <= last))


# S10 ----------------------------------------------------------------------
def apply_retention(df: DataFrame, policies: DataFrame, as_of: dt.datetime, ts_col: str,
                    days_col: str = "retention_days") -> DataFrame:
    """Keeps rows younger than their tenant's retention (in days) at
    ``as_of``; tenants without a policy keep everything. The policy table has
    one row per tenant."""
    p = lookup(policies.select("tenant_id", days_col))
    j = df.join(p, "tenant_id", "left")
    keep = F.col(days_col).isNull() | (F.col(ts_col) >= F.timestamp_add("DAY", -F.col(days_col), ts_lit(as_of)))
    return j.filter(keep).drop(days_col)


def retention_policies(configs: DataFrame) -> DataFrame:
    """Current retention per tenant from its newest config row."""
    return latest(configs.select("tenant_id", "updated_at", "config_id", "retention_days"),
                  "tenant_id", "updated_at", tie=["config_id"]).select("tenant_id", "retention_days")


# S11 ----------------------------------------------------------------------
PRIMARY_KEYS = {"tenants": "tenant_id", "calls": "call_id"}


def cascade_delete(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, str]],
                   root: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Removes the ``keys`` rows from table ``root`` and applies the
    foreign-key rules (child, fk column, parent, CASCADE | SET NULL) in the
    order given. Keys deleted from a cascaded child are propagated to its own
    children (calls -> turns). Anti, semi and left joins only."""
    out = dict(tables)
    deleted: dict[str, DataFrame] = {root: keys}
    out[root] = tables[root].join(keys, keys.columns, "left_anti")
    for child, fk, parent, rule in rules:
        gone = deleted.get(parent)
        if gone is None:
            continue
        pk = gone.columns[0]
        g = gone.select(F.col(pk).alias(fk)).distinct()
        cur = out[child]
        if rule == "CASCADE":
            removed = cur.join(g, fk, "left_semi")
            out[child] = cur.join(g, fk, "left_anti")
            child_key = PRIMARY_KEYS.get(child)
            if child_key:
                prev = deleted.get(child)
                rk = removed.select(child_key)
                deleted[child] = rk if prev is None else prev.unionByName(rk)
        elif rule == "SET NULL":
            hit = g.withColumn("_gone", F.lit(True))
            out[child] = cur.join(hit, fk, "left").withColumn(
                fk, F.when(F.col("_gone"), F.lit(None).cast(cur.schema[fk].dataType)).otherwise(F.col(fk))
            ).drop("_gone").select(*cur.columns)
        else:
            raise ValueError(rule)
    return out


# S12 ----------------------------------------------------------------------
def export_tenant(tables: dict[str, DataFrame], tenant, path: str) -> dict[str, str]:
    """Every table's rows of one tenant to ``path/<table>`` (Parquet).
    Returns the folder per table."""
    done = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        df.filter(F.col("tenant_id") == F.lit(tenant)).write.mode("overwrite").parquet(target)
        done[name] = target
    return done
