"""Column helpers (X1-X13). All are built-in Spark expressions, so they stay
inside whole-stage codegen (higher-order array functions are evaluated per
row inside the stage, still on the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X11 ----------------------------------------------------------------------
def ts_lit(value) -> Column:
    """``as_of`` and other fixed times as a ``timestamp_ntz`` literal, built
    from text so neither the session nor the Python time zone shifts it."""
    import datetime as dt

    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


# X1 -----------------------------------------------------------------------
def first_of(*cols: ColLike, default=None) -> Column:
    """First non-null value (the ``a ?? b ?? default`` rule)."""
    parts = [_c(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


# X2 -----------------------------------------------------------------------
def falsy_or(col: ColLike, default, numeric: bool = False) -> Column:
    """Falsy default (the ``a || default`` rule): NULL, '' and, for numbers, 0
    are replaced. A string "0" is kept, as it is truthy."""
    c = _c(col)
    bad = c.isNull() | ((c == 0) if numeric else (c == ""))
    return F.when(bad, F.lit(default)).otherwise(c)


# X3 -----------------------------------------------------------------------
def blank_cast(col: ColLike, type_: str) -> Column:
    """'' becomes NULL, then a checked cast; text that does not parse is NULL
    (use ``blank_cast_failed`` to route such rows to a reject table)."""
    return F.nullif(_c(col), F.lit("")).try_cast(type_)


def blank_cast_failed(col: ColLike, type_: str) -> Column:
    c = F.nullif(_c(col), F.lit(""))
    return c.isNotNull() & blank_cast(col, type_).isNull()


# X4 -----------------------------------------------------------------------
def details(**cols: ColLike) -> Column:
    """JSON object text from named columns (NULL members are dropped, as
    ``JSON.stringify`` drops undefined)."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in cols.items()]))


def parse_vector(col: ColLike) -> Column:
    """JSON array text to ``array<double>``; malformed text gives NULL."""
    return F.from_json(_c(col), "array<double>")


# X5 / X6 ----------------------------------------------------------------------
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: ColLike, b: ColLike) -> Column:
    """Cosine similarity over the shorter length; a zero norm product gives 0."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    n = F.least(F.size(a), F.size(b))
    a2, b2 = F.slice(a, 1, n), F.slice(b, 1, n)
    den = F.sqrt(_dot(a2, a2)) * F.sqrt(_dot(b2, b2))
    return _dot(a2, b2) / F.when(den == 0, F.lit(1.0)).otherwise(den)


def cosine_equal_len(a: ColLike, b: ColLike) -> Column:
    """Cosine for vectors already checked to have equal length (K6)."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    den = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _dot(a, b) / F.when(den == 0, F.lit(1.0)).otherwise(den)


def cosine_distance(a: ColLike, b: ColLike) -> Column:
    return F.lit(1.0) - cosine(a, b)


# X7 -----------------------------------------------------------------------
def score4(col: ColLike) -> Column:
    """Round to 4 places; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(_c(col), 4) + F.lit(0.0)


# X8 -----------------------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def simple_tokens(col: ColLike) -> Column:
    """Lower-cased letter/digit runs; no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def normalise_text(col: ColLike) -> Column:
    """Tokens joined by one space (for grouping equal questions)."""
    return F.array_join(simple_tokens(col), " ")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` names it:
    Spark would copy the expression to each place and, through projections, again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# X9 -----------------------------------------------------------------------
E164_PATTERN = r"^\+[1-9][0-9]{1,14}$"


def e164(col: ColLike, prefix: str = "+1") -> Column:
    """Phone text to ``+digits``: a leading + or 00 keeps the country code,
    more than 10 digits are taken as already international, shorter ones get
    ``prefix``. Results that are not valid E.164 are NULL."""
    def spelled(raw: Column) -> Column:
        return once(F.regexp_replace(raw, r"[^0-9]", ""), lambda digits: (
            F.when(raw.startswith("+"), F.concat(F.lit("+"), digits))
             .when(digits.startswith("00"), F.concat(F.lit("+"), F.substr(digits, F.lit(3))))
             .when(F.length(digits) > 10, F.concat(F.lit("+"), digits))
             .otherwise(F.concat(F.lit(prefix), digits))))

    # the spelled form is '+' and digits by construction, so the E.164 pattern reduces
    # to: 2-15 digits, the first not 0 (checked without a second regex)
    return once(once(F.trim(_c(col)), spelled), lambda out: F.when(
        F.length(out).between(3, 16) & (F.substring(out, 2, 1) != "0"), out))


# X10 ----------------------------------------------------------------------
def join_top(arr: ColLike, k: int, sep: str) -> Column:
    return F.array_join(F.slice(_c(arr), 1, k), sep)


# X12 ----------------------------------------------------------------------
def content_key(*cols: ColLike) -> Column:
    """Deterministic row id: SHA-256 of the fields (NULL kept distinct from
    ''), so retries and replays give the same key."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("\\N")) for c in cols]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


# X13 ----------------------------------------------------------------------
def storage_key(tenant: ColLike, name: ColLike) -> Column:
    return F.concat(F.lit("tenants/"), _c(tenant).cast("string"), F.lit("/"), _c(name))


def storage_tenant(key: ColLike) -> Column:
    return F.nullif(F.regexp_extract(_c(key), r"^tenants/([^/]+)/", 1), F.lit(""))


def storage_name(key: ColLike) -> Column:
    return F.nullif(F.regexp_extract(_c(key), r"^tenants/[^/]+/(.+)$", 1), F.lit(""))
