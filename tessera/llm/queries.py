"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from . import bpe, conversation_repair, embedding_dedup, html_extract, language_id, line_dedup, lm_score, merkle, near_dedup, oracle_sql, packing, toxicity
from . import exact_dedup as dedup
from . import license_scan as lic
from .registry import register
from .util import table


@register("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op5_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


@register("op10_license_scan", lic.oracle_sql())
def op10_license_scan(spark, sf_dir):
    return lic.license_scan(table(spark, sf_dir, "documents"), lic.known_licenses(spark), fixed=lic.license_texts.DIGESTS)


@register("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op7_bpe")
def op7_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@register("op1_language_id")
def op1_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_html_extract")
def op4_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


@register("op6_embedding_dedup")
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@register("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@register("op13_merkle_manifest", oracle_sql.MERKLE)
def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@register("op12_line_dedup", line_dedup.ORACLE_SQL)
def op12_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs), digest=True)


@register("op11_conversation_repair", oracle_sql.REPAIR)
def op11_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(turns), ids=turns)
