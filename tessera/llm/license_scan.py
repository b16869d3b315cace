"""Operator 10: licence scan by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made equal word for word, everything but letters and digits one
space. The digest of the whole canonical text is joined with the digests of
known licences: the built-in texts and fixed digests of long public licences.
Each line of a document is looked up as a text of its own in the same way, so a
one-line licence notice inside a longer document is found too. A line is looked up inside its own row, so
no row needs a name and nothing depends on how often Spark evaluates the input.

Defined cases: a null text counts as empty; a text without letters or digits
has the digest of the empty text and matches nothing; repeated rows give repeated rows;
a known licence listed twice with one canonical form is
reported under its smallest id; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .util import text_of

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}©(\n]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _spelled(form: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words replaced; words stand between at least two spaces, so neighbours don't share one."""
    return reduce(lambda c, p: F.replace(c, F.lit(_word(p[0])), F.lit(_word(p[1]))), pairs, form)


def _word(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


SEVERAL = [p for p in license_texts.SPELLINGS if " " in p[0]]


def _lines_form(text: Column) -> Column:
    """Lower-cased words, two spaces around each, line ends kept."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "(?d)" + COPYRIGHT_LINE, " "), NOT_WORD, "  ")
    return _spelled(F.concat(F.lit("  "), F.replace(t, F.lit("\n"), F.lit("  \n  ")), F.lit("  ")), license_texts.SPELLINGS)


def _whole(form: Column) -> Column:
    """The canonical form of the whole text: pairs of words may stand on both sides of a line end."""
    spread = _spelled(F.regexp_replace(form, r"\s+", "  "), SEVERAL)
    return F.trim(F.replace(spread, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a text (never null for a non-null text)."""
    return _whole(_lines_form(text))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, text) rows of the built-in texts, or of ``texts``."""
    return spark.createDataFrame(texts or license_texts.KNOWN, "license_id string, text string")


def digests(known: DataFrame, fixed: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, n): one row per canonical form with its length (null for ``fixed``, (id, digest) pairs); empty forms are left out."""
    forms = known.select("license_id", canonical(text_of("text")).alias("_c")).filter("_c <> ''") \
                 .select(F.sha2("_c", 256).alias("digest"), "license_id", F.length("_c").alias("n"))
    if fixed:
        forms = forms.unionByName(known.sparkSession.createDataFrame([(d, i, None) for i, d in fixed], "digest string, license_id string, n int"))
    return forms.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("n").alias("n"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fixed: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: ``id_col``, text_digest (of the canonical whole text), license_id (known
    licence equal to the whole text, or null), notice_ids (licences that a line equals: distinct,
    sorted, joined by a comma; '' if none), n_notices (lines that equal one).

    ``known`` is a list of licences, not data: its digests (about 100 bytes each) come to the driver and
    go into the plan as a literal, for the lines; the whole texts are joined with the same list."""
    table = [tuple(r) for r in digests(known, fixed).sort("digest").collect()]
    listed = docs.sparkSession.createDataFrame(table, "digest string, license_id string, n int")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), _lines_form(text_of(f"`{text_col}`")).alias("_form"))
    lengths = sorted({n for _, _, n in table if n is not None})
    named = F.create_map(*[F.lit(x) for d, i, n in table if n is not None for x in (d, i)])
    lines = F.transform(F.split("_form", "\n"), lambda line: F.trim(F.replace(line, F.lit("  "), F.lit(" "))))
    # only a line as long as a known form can equal it
    some = F.filter(lines, lambda c: F.length(c).isin(lengths))
    hits = F.filter(F.transform(some, lambda c: F.element_at(named, F.sha2(c, 256))), lambda i: i.isNotNull())
    none = F.array().cast("array<string>")
    rows = rows.select("_id", F.sha2(_whole(F.col("_form")), 256).alias("text_digest"), (hits if lengths else none).alias("_hits"))
    return rows.join(listed.select(F.col("digest").alias("text_digest"), "license_id"), "text_digest", "left").select(
        F.col("_id").alias(id_col), "text_digest", "license_id",
        F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("notice_ids"), F.size("_hits").cast("long").alias("n_notices"))


def oracle_sql(doc_table: str = "documents") -> str:
    """The same scan over the built-in texts and fixed digests in DuckDB SQL."""
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def spelled(out: str, pairs) -> str:
        for a, b in pairs:
            out = f"replace({out}, {lit(_word(a))}, {lit(_word(b))})"
        return out

    def canon(t: str) -> str:
        words = f"regexp_replace(regexp_replace(lower({t}), {lit(COPYRIGHT_LINE)}, ' ', 'g'), {lit(NOT_WORD)}, '  ', 'g')"
        form = spelled(f"'  ' || replace({words}, chr(10), '  ' || chr(10) || '  ') || '  '", license_texts.SPELLINGS)
        spread = spelled(f"regexp_replace({form}, '\\s+', '  ', 'g')", SEVERAL)
        return f"trim(replace({spread}, '  ', ' '), ' ')"

    known = ", ".join(f"({lit(i)}, {lit(t)})" for i, t in license_texts.KNOWN)
    fixed = ", ".join(f"({lit(d)}, {lit(i)})" for i, d in license_texts.DIGESTS)
    return f"""
    WITH known(license_id, text) AS (VALUES {known}),
    digests AS (SELECT digest, min(license_id) AS license_id FROM (
                  SELECT sha256(c) AS digest, license_id FROM (SELECT license_id, {canon('text')} AS c FROM known) k WHERE c <> ''
                  UNION ALL SELECT * FROM (VALUES {fixed}) f(digest, license_id)) GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {doc_table}),
    whole AS (SELECT rid, sha256({canon('text')}) AS text_digest FROM docs),
    lines AS (SELECT rid, {canon('line')} AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) x),
    found AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids, count(*) AS n_notices
              FROM lines JOIN digests ON digest = sha256(c) WHERE c <> '' GROUP BY rid)
    SELECT doc_id, text_digest, license_id,
           coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0) AS n_notices
    FROM docs JOIN whole USING (rid) LEFT JOIN digests ON digest = text_digest LEFT JOIN found ON found.rid = docs.rid"""
