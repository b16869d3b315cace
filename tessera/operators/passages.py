"""Retrieval by passage over whole texts: K12 and K10 on the chunks of every
document, the answer being the chunk that matched.

A document is cut by K1 into overlapping chunks; postings and vectors are
those of its chunks, so a fact at any place of a text of any length can be found. A
document's score is that of its best chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize
from .kb_text import CHUNK_OVERLAP, CHUNK_SIZE, best_by_cosine, bm25_top, build_postings, chunk_documents, listed, of_asked_tenants, posting_lists
from .vector_store import with_vectors


def passage_id(doc_id="doc_id", chunk_no="chunk_no") -> Column:
    """Name of a chunk: its document and its number, in text order."""
    return F.concat(F.col(doc_id).cast("string"), F.lit(":"), F.lpad(F.col(chunk_no).cast("string"), 8, "0"))


def passages(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, tenant_id, chunk_no, chunk_id, chunk) of whole documents."""
    return chunk_documents(docs, size, overlap).select("doc_id", "tenant_id", "chunk_no", passage_id().alias("chunk_id"), "chunk")


def _named(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return passages(docs, size, overlap).select("tenant_id", F.struct("doc_id", "chunk_no").alias("passage"), "chunk")


def build_passage_postings(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """K11 by chunk: (tenant_id, doc_id, chunk_no, term, tf, dl). Map-only, like K11."""
    return build_postings(_named(docs, size, overlap), "passage", "chunk").select("tenant_id", "passage.doc_id", "passage.chunk_no", "term", "tf", "dl")


def passage_lists(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``build_passage_postings`` with one row per chunk: (tenant_id, doc_id, chunk_no, dl, docs, n, terms, tfs)."""
    return posting_lists(_named(docs, size, overlap), "passage", "chunk").select("tenant_id", "passage.doc_id", "passage.chunk_no", "dl", "docs", "n", "terms", "tfs")


def search_passages(queries: DataFrame, docs: DataFrame | None, k: int = 8, postings: DataFrame | None = None,
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(query_id, tenant_id, doc_id, chunk_no, score, rank): per query the best ``k`` documents of its
    tenant by the BM25 score of their best chunk (the first of equal ones).

    Posting lists are dealt by document, so a document's chunks meet in one task and only its best
    goes on; a task ships k documents per question."""
    ids = ["doc_id", "chunk_no"]
    lists = listed(postings, ids) if postings is not None else passage_lists(of_asked_tenants(docs, queries), size, overlap)
    asked, top = bm25_top(queries, materialize(lists), ids, k)
    return asked.join(top, ["tenant_id", "_q"]).select("query_id", "tenant_id", "doc_id", "chunk_no", "score", "rank")


def search_passage_vectors(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, tenant_id, chunk_id, doc_id, chunk_no, score, rank): K10 on the stored vectors of
    ``chunks``, for any number of questions: they meet in cells of bounded size."""
    counts = chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_items"))
    return best_by_cosine(queries, with_vectors(chunks, vectors, text_col="chunk"), k, "chunk_id", ("chunk_id", "doc_id", "chunk_no"), counts=counts)


def passage_texts(hits: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ("title", "source"),
                  size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``hits`` (doc_id, chunk_no, ..) with the text of the chunk and the document's ``keep``
    columns. A document's text travels once, to its hits, which take their chunks where they meet it: chunks that
    travel to the hits would be the same text again, and all chunks more than it."""
    old = [c for c in hits.columns if c not in ("doc_id", "chunk_no")]
    at = lookup(hits).select("doc_id", *[F.col(c).alias(f"_hit_{c}") for c in old], F.array("chunk_no").alias("_wanted"))
    met = at.join(docs.select("doc_id", "content", *keep), "doc_id")
    cut = chunk_documents(met, size, overlap, keep=("doc_id", *[f"_hit_{c}" for c in old], *keep), only="_wanted")
    return cut.select("doc_id", "chunk_no", *[F.col(f"_hit_{c}").alias(c) for c in old], *keep, "chunk")
