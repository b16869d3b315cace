"""Knowledge-base text work: chunking (K1-K3), tagging (K4), page text
(K5), re-indexing (K9), inverted index and BM25 (K11, K12), hybrid fusion
(K13), evaluation (K17), structured rows and the knowledge union (S3, U2),
file source (S2).

Everything is expressed over whole tables; one document's text is handled
inside one row (its chunks are exploded from it), so no group holds more
than one document's pieces.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import content_key, simple_tokens
from .batches import parts, tidy
from .common import materialize, lookup, top_k_per
from .pair_blocks import POSTINGS, VECTORS, best_cosines, best_sums, by_cell

# Splitter settings of the reference ingest (characters).
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120

# What a map in Python works on at once: tokens and bytes of text.
PART_TOKENS = 1 << 18
PART_BYTES = 4 << 20


# K1: fixed-stride form ------------------------------------------------------------
def chunk_count(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return (F.when(length == 0, F.lit(0))
             .when(length <= size, F.lit(1))
             .otherwise(F.ceil((length - F.lit(overlap)) / F.lit(step)).cast("int")))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    text_col: str = "content", keep: tuple[str, ...] = ("doc_id", "tenant_id"), only: str | None = None) -> DataFrame:
    """K1 (fixed form): windows of ``size`` characters every ``size - overlap``
    characters, the last one covering the tail; chunk number and start offset
    kept. Empty text gives no chunk, text up to ``size`` gives one. ``only`` names a column
    with the numbers of the chunks to cut, where not all are asked for."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = chunk_count(F.coalesce(F.length(text_col), F.lit(0)), size, overlap)
    numbers = F.sequence(F.lit(0), F.col("_n") - 1)
    d = docs.select(*keep, F.col(text_col).alias("_t"), n.alias("_n"), *([F.col(only).alias("_only")] if only else []))
    d = d.filter(F.col("_n") > 0).select(*keep, "_t", F.explode(F.array_intersect(numbers, "_only") if only else numbers).alias("chunk_no"))
    start = F.col("chunk_no") * step
    return d.select(*keep, "chunk_no", start.alias("start"),
                    F.substring(F.col("_t"), start + 1, F.lit(size)).alias("chunk"))


# K1: recursive form -------------------------------------------------------------
SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=SEPARATORS) -> list[tuple[int, str]]:
    """Recursive character splitter: split on the first separator that occurs,
    recurse into pieces longer than ``size``, then merge neighbouring pieces up
    to ``size`` characters, carrying up to ``overlap`` characters of the
    previous chunk. Returns (start offset, chunk) pairs."""
    if not text:
        return []

    def pieces(s: str, seps) -> list[str]:
        if len(s) <= size:
            return [s]
        sep = next((x for x in seps if x == "" or x in s), "")
        rest = seps[seps.index(sep) + 1:] if sep in seps else ()
        if sep == "":
            return [s[i:i + size] for i in range(0, len(s), size)]
        parts = s.split(sep)
        out = []
        for i, p in enumerate(parts):
            p2 = p + (sep if i < len(parts) - 1 else "")
            if not p2:
                continue
            out.extend(pieces(p2, rest) if len(p2) > size else [p2])
        return out

    chunks: list[tuple[int, str]] = []
    pos = 0
    cur, cur_start = "", 0
    for p in pieces(text, tuple(separators)):
        if cur and len(cur) + len(p) > size:
            chunks.append((cur_start, cur))
            tail = cur[-overlap:] if overlap else ""
            # keep the overlap only if the next piece still fits after it
            if len(tail) + len(p) > size:
                tail = ""
            cur_start = pos - len(tail)
            cur = tail
        if not cur:
            cur_start = pos
        cur += p
        pos += len(p)
    if cur:
        chunks.append((cur_start, cur))
    return chunks


def _separator_ends(chars, first, sep: str):
    """Ends of the separator's occurrences in the texts that lie one after the other in ``chars`` (texts
    begin at ``first``), found from each text's start and never overlapping."""
    import numpy as np

    at = np.flatnonzero(chars == ord(sep[0]))
    if len(sep) == 1 or not at.size:
        return at + 1
    # a run of n equal characters holds n // len(sep) of them; no run crosses a text's end
    new = np.ones(at.size, bool)
    new[1:] = (np.diff(at) != 1) | np.isin(at[1:], first)
    start = at[new][np.cumsum(new) - 1]
    place = at - start + 1
    return at[place % len(sep) == 0] + 1


def split_batch(texts: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS):
    """``split_recursive`` of many texts at once: (text number, chunk number, start, end) as arrays.

    Each separator's places are found once for the batch; a level cuts all segments that are
    still too long by one sorted merge. Chunks are then read off the pieces' ends: the next chunk of
    every text at once, by one binary search per chunk number. Separators of several characters repeat one."""
    import numpy as np

    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    last = first + lengths
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.unique(last[lengths > 0])
    for sep in separators:
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts > size
        if not long.any():
            break
        if sep:
            cut = _separator_ends(chars, first, sep)
            seg = np.searchsorted(ends, cut, "left")
            cut = cut[long[seg]]
        else:
            pieces = (ends - starts - 1) // size * long
            seg = np.repeat(np.arange(ends.size), pieces)
            nth = np.arange(seg.size) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
            cut = starts[seg] + nth * size
        ends = np.union1d(ends, cut)
    out = []
    live, start, number = np.flatnonzero(lengths > 0), first[lengths > 0], 0
    while live.size:
        k = np.searchsorted(ends, np.minimum(start + size, last[live]), "right") - 1
        end = ends[k]
        out.append((live, np.full(live.size, number), start - first[live], end - first[live]))
        more = end < last[live]
        live, start, end, k, number = live[more], start[more], end[more], k[more], number + 1
        tail = np.minimum(overlap, end - start)
        tail[tail + ends[k + 1] - end > size] = 0
        start = end - tail
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cols = [np.concatenate(c) for c in zip(*out)]
    order = np.lexsort((cols[1], cols[0]))
    return tuple(c[order] for c in cols)


RECURSIVE_SCHEMA = "doc_id long, tenant_id int, chunk_no int, start int, chunk string"


def chunk_documents_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                              text_col: str = "content") -> DataFrame:
    """K1 (recursive form) as ``mapInArrow``: each task splits the documents of its own partition a
    batch at a time (``split_batch``); nothing is grouped or collected."""
    import pyarrow as pa

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, 2, size=PART_BYTES)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            doc, number, start, end = split_batch(texts, size, overlap)
            chunks = [texts[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist())]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()),
                                              pa.array(start, pa.int32()), pa.array(chunks, pa.string())], ["doc_id", "tenant_id", "chunk_no", "start", "chunk"])

    return docs.select(F.col("doc_id").cast("long"), F.col("tenant_id").cast("int"), text_col).mapInArrow(tidy(run), RECURSIVE_SCHEMA)


# K2 -----------------------------------------------------------------------
HEADING_SPLIT = r"(?m)(?=^#{1,6} )|(?i)(?=<h[1-6][ >])"


def split_sections(docs: DataFrame, text_col: str = "content", keep: tuple[str, ...] = ("doc_id", "tenant_id")) -> DataFrame:
    """K2: split Markdown (``#`` lines) and HTML (``<hN>``) documents at headings;
    each section keeps its heading text (NULL for the part before the first
    heading). Empty sections are dropped."""
    parts = F.split(F.col(text_col), HEADING_SPLIT)
    d = docs.select(*keep, F.posexplode(parts).alias("section_no", "section"))
    d = d.filter(F.length(F.trim("section")) > 0)
    md = F.regexp_extract("section", r"^#{1,6} +([^\n]*)", 1)
    html = F.regexp_extract("section", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    heading = F.nullif(F.trim(F.coalesce(F.nullif(md, F.lit("")), html)), F.lit(""))
    return d.select(*keep, "section_no", heading.alias("heading"), "section")


# K3 -----------------------------------------------------------------------
def qa_chunks(qa: DataFrame) -> DataFrame:
    """K3: one chunk per question with its answer; never split."""
    return qa.select("*", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer")).alias("chunk"))


def qa_from_turns(turns: DataFrame) -> DataFrame:
    """Question/answer pairs from conversations: each caller turn and the agent
    turn right after it (equi join on call and turn number, 1:1)."""
    q = turns.filter(F.col("role") == "caller").select(
        "call_id", "tenant_id", F.col("turn_no").alias("q_turn"), F.col("content").alias("question"))
    a = turns.filter(F.col("role") == "agent").select(
        "call_id", (F.col("turn_no") - 1).alias("q_turn"), F.col("content").alias("answer"))
    return q.join(a, ["call_id", "q_turn"], "inner")


# K4 -----------------------------------------------------------------------
def tag_chunks(chunks: DataFrame, docs: DataFrame, tenants: DataFrame) -> DataFrame:
    """K4: tenant, document, title, source, section, sector and language on
    every chunk, as columns and as one ``metadata`` map."""
    d = docs.select("doc_id", "title", "source", "lang")
    t = lookup(tenants.select("tenant_id", F.col("name").alias("tenant_name"), "sector"))
    out = chunks.join(d, "doc_id", "left").join(t, "tenant_id", "left")
    if "heading" not in out.columns:
        out = out.withColumn("heading", F.lit(None).cast("string"))
    meta = F.create_map(
        F.lit("tenant"), F.col("tenant_id").cast("string"), F.lit("document"), F.col("doc_id").cast("string"),
        F.lit("title"), F.col("title"), F.lit("source"), F.col("source"), F.lit("section"), F.col("heading"),
        F.lit("sector"), F.col("sector"), F.lit("language"), F.col("lang"))
    return out.withColumn("metadata", meta)


# K5 -----------------------------------------------------------------------
def unescape(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with the character references of text columns (named, decimal and hexadecimal, with or
    without the closing semicolon as HTML reads them) as characters, a few MB of text at a time: the list of
    names is the standard library's."""
    import html

    import pyarrow as pa

    at = [df.columns.index(c) for c in cols]

    def run(batches):
        for rb in (part for batch in batches for part in parts(batch, *at, size=PART_BYTES)):
            arrays = list(rb.columns)
            for i in at:
                arrays[i] = pa.array([t if t is None else html.unescape(t) for t in arrays[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, rb.schema.names)

    return df.mapInArrow(tidy(run), df.schema)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """K5: page title and readable text from raw HTML: script, style and
    comments removed, tags replaced by spaces (native regex functions),
    character references decoded, white space and no-break spaces
    collapsed."""
    h = F.col(html_col)
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?is)<title[^>]*>.*?</title>", " ")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    tidied = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n\x{a0}]+", " ")).alias(c)
    rest = [c for c in pages.columns if c not in (html_col, "title", "text")]
    raw = pages.select(*rest, title.alias("title"), body.alias("text"))
    return unescape(raw, "title", "text").select(*rest, tidied("title"), tidied("text"))


# K9 -----------------------------------------------------------------------
def reindex(new_docs: DataFrame, old_docs: DataFrame, old_chunks: DataFrame, size: int = CHUNK_SIZE,
            overlap: int = CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """K9: incremental re-index. A document is compared by tenant and content
    hash (a NULL content equals only a NULL content): new or changed ones,
    and those moved to another tenant, are chunked again; removed ones lose
    their chunks; unchanged ones keep theirs as they are. Returns (plan,
    chunks) where plan has one row per document id with ``action`` new /
    changed / unchanged / removed."""
    n = new_docs.select("doc_id", "tenant_id", "content", F.sha2("content", 256).alias("new_hash"), F.lit(True).alias("_new"))
    o = old_docs.select("doc_id", F.col("tenant_id").alias("_old_tenant"), F.sha2("content", 256).alias("old_hash"),
                        F.lit(True).alias("_old"))
    same = F.col("new_hash").eqNullSafe(F.col("old_hash")) & F.col("tenant_id").eqNullSafe(F.col("_old_tenant"))
    plan = n.join(o, "doc_id", "full").select(
        "doc_id", F.when(F.col("_new"), F.col("tenant_id")).otherwise(F.col("_old_tenant")).alias("tenant_id"),
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed")
         .when(same, "unchanged").otherwise("changed").alias("action"), "content")
    todo = plan.filter(F.col("action").isin("new", "changed"))
    fresh = chunk_documents(todo, size, overlap)
    keep_ids = plan.filter(F.col("action") == "unchanged").select("doc_id")
    kept = old_chunks.join(keep_ids, "doc_id", "left_semi")
    return plan.drop("content"), kept.unionByName(fresh)


# K11 ----------------------------------------------------------------------
def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """The inverted index as a table: (tenant, id, term, tf, dl), one row
    per document and distinct term, and one row with a NULL term per document that
    carries its length (also of documents without a token).

    Map-only: Spark tokenises (X8), a task counts the terms of its own
    documents on whole Arrow batches. Written once, it serves every search."""
    import numpy as np
    import pyarrow as pa

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("tenant_id", id_col)}
    names = ["tenant_id", id_col, "term", "tf", "dl"]

    def run(batches):
        for rb in (part for batch in batches for part in parts(batch, 2, size=PART_TOKENS)):
            rows, words, tf, lengths = _counted(rb.column(2))
            row = np.concatenate([np.arange(rb.num_rows), rows])
            term = pa.concat_arrays([pa.nulls(rb.num_rows, pa.string()), words])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take), term,
                                              pa.array(np.concatenate([np.zeros(rb.num_rows, np.int64), tf])), pa.array(lengths[row])], names)

    return _tokenised(docs, id_col, text_col).mapInArrow(
        tidy(run), f"tenant_id {kinds['tenant_id']}, `{id_col}` {kinds[id_col]}, term string, tf long, dl long")


def _tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select("tenant_id", id_col, F.coalesce(simple_tokens(text_col), F.array().cast("array<string>")).alias("_tok"))


def _counted(toks):
    """(row, term, tf) of each distinct term of a row of tokens, by row, and the rows' numbers of tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = np.asarray(pc.list_value_length(toks)).astype(np.int64)
    enc = pc.dictionary_encode(pc.list_flatten(toks))
    size = max(1, len(enc.dictionary))
    pair, tf = np.unique(np.repeat(np.arange(len(toks)), lengths) * size + np.asarray(enc.indices).astype(np.int64), return_counts=True)
    return pair // size, enc.dictionary.take(pa.array(pair % size)).cast(pa.string()), tf, lengths


def posting_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """K11 with one row per document: (tenant, id, dl, docs, n, terms, tfs), its ``n`` distinct terms joined by a space
    and how often it holds each. Map-only; a tenth of the rows of ``build_postings`` or less, for searches that read all."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("tenant_id", id_col)}

    def run(batches):
        for rb in (part for batch in batches for part in parts(batch, 2, size=PART_TOKENS)):
            rows, words, tf, lengths = _counted(rb.column(2))
            upto = pa.array(np.searchsorted(rows, np.arange(rb.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), pa.array(lengths), pa.array(np.ones(rb.num_rows, np.int64)), pa.array(np.diff(np.asarray(upto)), pa.int32()),
                 pc.binary_join(pa.ListArray.from_arrays(upto, words), " "), pa.ListArray.from_arrays(upto, pa.array(tf, pa.int32()))],
                ["tenant_id", id_col, "dl", "docs", "n", "terms", "tfs"])

    return _tokenised(docs, id_col, text_col).mapInArrow(
        tidy(run), f"tenant_id {kinds['tenant_id']}, `{id_col}` {kinds[id_col]}, dl long, docs long, n int, terms string, tfs array<int>")


def listed(postings: DataFrame, ids: list[str]) -> DataFrame:
    """Stored postings as ``posting_lists``. Items of the same ids and length are one row with ``docs`` of them; a
    term with a space is no token, so no question holds it."""
    held = F.collect_list(F.when(~F.contains("term", F.lit(" ")), F.struct("term", F.col("tf").cast("int").alias("tf"))))
    g = postings.groupBy("tenant_id", *ids, "dl").agg(F.count_if(F.col("term").isNull()).alias("docs"), held.alias("_l"))
    return g.select("tenant_id", *ids, "dl", "docs", F.size("_l").alias("n"), F.array_join(F.col("_l.term"), " ").alias("terms"), F.col("_l.tf").alias("tfs"))


def list_statistics(lists: DataFrame) -> DataFrame:
    """K11's df by tenant and term from ``posting_lists``, counted a few MB of text at a time before the shuffle."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = lists.schema["tenant_id"].dataType.simpleString()

    def run(batches):
        for rb in (part for batch in batches for part in parts(batch, 1, size=PART_BYTES)):
            toks = pc.split_pattern(rb.column(1), " ")
            term, tenant = pc.dictionary_encode(pc.list_flatten(toks)), pc.dictionary_encode(rb.column(0))
            owner = np.repeat(np.asarray(tenant.indices).astype(np.int64), np.asarray(pc.list_value_length(toks)))
            size = max(1, len(term.dictionary))
            pair, n = np.unique(owner * size + np.asarray(term.indices), return_counts=True)
            yield pa.RecordBatch.from_arrays([tenant.dictionary.take(pa.array(pair // size)), term.dictionary.take(pa.array(pair % size)).cast(pa.string()),
                                              pa.array(n, pa.int64())], ["tenant_id", "term", "df"])

    counted = lists.filter("n > 0").select("tenant_id", "terms").mapInArrow(tidy(run), f"tenant_id {kind}, term string, df long")
    return counted.groupBy("tenant_id", "term").agg(F.sum("df").alias("df"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """Per tenant and term, in how many documents (df) and how often (cf)."""
    return postings.filter(F.col("term").isNotNull()).groupBy("tenant_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def build_terms(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(postings, statistics); the postings are written once."""
    postings = materialize(build_postings(chunks, id_col, text_col))
    return postings, term_statistics(postings)


# K12 ----------------------------------------------------------------------
VOCABULARY_ROWS = 64      # of a tenant


def questions_by_terms(queries: DataFrame) -> DataFrame:
    """(query_id, tenant_id, _q, _terms): the distinct terms in order; ``_q`` is the same for questions with the same terms."""
    terms = F.coalesce(F.array_join(F.array_sort(F.array_distinct(simple_tokens("query_text"))), " "), F.lit(""))
    return queries.select("query_id", "tenant_id", terms.alias("_terms")).withColumn("_q", F.unhex(F.md5("_terms")))


def of_asked_tenants(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The documents that a question can find: those of tenants that ask one."""
    return docs.join(lookup(queries.select("tenant_id").distinct()), "tenant_id", "left_semi")


def bm25_top(queries: DataFrame, lists: DataFrame, ids: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` ids[0] of each question by BM25 on stored posting lists of items named by ``ids`` (the score of several
    items with the same ids[0] is that of the best): the questions (query_id, tenant_id, _q)
    and (tenant_id, _q, ids, score, rank).

    Questions of a tenant with the same terms are scored once. Posting lists, questions and the tenant's statistics of their terms
    meet in cells of bounded size (``pair_blocks``), in which a score is complete: postings travel once per block of questions, one row per
    item, and are never joined to the terms; pairs of a question and an item stay inside a task,
    which ships k rows per question. No side is hinted; Spark broadcasts what is under its byte threshold."""
    asked = questions_by_terms(queries)
    once = materialize(asked.filter(F.col("_terms") != "").groupBy("tenant_id", "_q").agg(F.first("_terms").alias("_terms")))
    stats = lists.groupBy("tenant_id").agg(F.sum("docs").alias("_n"), (F.sum(F.col("dl") * F.col("docs")) / F.sum("docs")).alias("_avgdl"), F.sum("n").alias("n_items"))
    wanted = lookup(once.select("tenant_id", F.explode(F.split("_terms", " ")).alias("term")).distinct())
    vocabulary = list_statistics(lists).join(wanted, ["tenant_id", "term"], "left_semi") \
        .groupBy("tenant_id", F.pmod(F.xxhash64("term"), F.lit(VOCABULARY_ROWS)).alias("_v")).agg(F.collect_list(F.struct("term", "df")).alias("_l"))
    known = lookup(vocabulary.join(stats, "tenant_id").select("tenant_id", F.array_join(F.col("_l.term"), " ").alias("_terms"), F.col("_l.df").alias("_df"), "_n", "_avgdl"))
    sizes = stats.select("tenant_id", "n_items").join(once.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_questions")), "tenant_id")
    schema = T.StructType([once.schema["tenant_id"], once.schema["_q"], *[lists.schema[c] for c in ids], T.StructField("score", T.DoubleType())])
    items = lists.filter("n > 0").select("tenant_id", *ids, "dl", "terms", "tfs")
    scored = by_cell(items, ids[0], once, "_q", sizes, POSTINGS, lambda left, right: best_sums(left, right, ids, k, k1, b), schema, wide=4, shared=known)
    top = top_k_per(scored, ["tenant_id", "_q"], [F.col("score").desc(), *[F.col(c) for c in ids]], k, rank_col="rank")
    return asked.drop("_terms"), top


def keyword_search(queries: DataFrame, docs: DataFrame | None, k: int = 8, k1: float = 1.2, b: float = 0.75,
                   id_col: str = "doc_id", text_col: str = "content", postings: DataFrame | None = None) -> DataFrame:
    """BM25 (Robertson/Sparck Jones idf with +1, k1, b) of each query
    against the documents of its tenant, with that tenant's statistics;
    distinct query terms; rank by score rounded to 6 places, then id.

    Reads the stored index (``postings``, else K11 writes it from ``docs`` as
    ``posting_lists``: each document is tokenised once); a task ships k rows per question
    to the ranking."""
    lists = listed(postings, [id_col]) if postings is not None else posting_lists(of_asked_tenants(docs, queries), id_col, text_col)
    asked, best = bm25_top(queries, materialize(lists), [id_col], k, k1, b)
    return asked.join(best, ["tenant_id", "_q"]).select("query_id", "tenant_id", id_col, "score", "rank")


# K7 (offline baseline embedder) -------------------------------------------------
def hash_embed(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 64) -> DataFrame:
    """Deterministic text embedding without a model: signed feature hashing
    of tokens (bucket from the first 8 hex digits of the token's MD5, sign
    from the 9th), L2-normalised. Rows with no token get a zero vector.

    Map-only: Spark tokenises (X8), then ``mapInArrow`` works on whole Arrow
    batches: the batch's tokens are dictionary-encoded, MD5 runs once per
    distinct token of the batch, and the buckets are summed with numpy. No
    shuffle, so a tenant or document of any size costs no hot task."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    src = df.select(*id_cols, simple_tokens(text_col).alias("_tok"))
    schema = T.StructType([src.schema[c] for c in id_cols] +
                          [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for rb in (part for batch in batches for part in parts(batch, len(id_cols), size=PART_TOKENS)):
            n = rb.num_rows
            toks = rb.column(rb.schema.get_field_index("_tok"))
            flat = pc.list_flatten(toks)
            rows = np.asarray(pc.list_parent_indices(toks))
            m = np.zeros((n, dim))
            if len(flat):
                enc = pc.dictionary_encode(flat).combine_chunks() if hasattr(flat, "chunks") else pc.dictionary_encode(flat)
                words = enc.dictionary.to_pylist()
                bucket = np.empty(len(words), dtype=np.int64)
                sign = np.empty(len(words), dtype=np.float64)
                for i, w in enumerate(words):
                    h = hashlib.md5(w.encode("utf-8")).hexdigest()
                    bucket[i] = int(h[:8], 16) % dim
                    sign[i] = 1.0 if int(h[8], 16) < 8 else -1.0
                idx = np.asarray(enc.indices)
                np.add.at(m, (rows, bucket[idx]), sign[idx])
            norm = np.sqrt((m * m).sum(axis=1))           # integer sums: exact in any order
            m = np.divide(m, norm[:, None], out=m, where=norm[:, None] > 0)
            emb = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)),
                                           pa.array(m.ravel()))
            cols = [rb.column(rb.schema.get_field_index(c)) for c in id_cols] + [emb]
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "embedding"])

    return src.mapInArrow(tidy(run), schema)


def vector_search_docs(queries: DataFrame, doc_vecs: DataFrame, k: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Exact cosine top-k of query vectors against the document vectors of
    the query's tenant, in cells of bounded size (``pair_blocks``); vectors of
    different lengths have no score."""
    return best_by_cosine(queries, doc_vecs, k, id_col, (id_col,), equal_len=True)


def best_by_cosine(queries: DataFrame, items: DataFrame, k: int, id_col: str, keep: tuple[str, ...], equal_len: bool = False,
                   counts: DataFrame | None = None, vec_col: str = "embedding") -> DataFrame:
    """(query_id, tenant_id, keep, score, rank): the exact best ``k`` items of each question's tenant, by
    cosine rounded to 4 and ``id_col``. ``counts`` (tenant_id, n_items) spares a pass over ``items``."""
    asked = queries.select("query_id", "tenant_id", "query_vec")
    rows = items.select("tenant_id", *keep, F.col(vec_col).cast("array<double>").alias("embedding"))
    counts = counts if counts is not None else items.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_items"))
    sizes = counts.join(asked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_questions")), "tenant_id")
    schema = T.StructType([*[asked.schema[c] for c in ("query_id", "tenant_id")], *[items.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    found = by_cell(rows, id_col, asked.withColumn("query_vec", F.col("query_vec").cast("array<double>")), "query_id", sizes, VECTORS,
                    lambda left, right: best_cosines(left, right, id_col, list(keep), k, equal_len=equal_len), schema)
    return top_k_per(found, "query_id", [F.col("score").desc(), F.col(id_col)], k, rank_col="rank")


# K13 ----------------------------------------------------------------------
def hybrid_search(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 8, rrf_k: int = 60,
                  id_col: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query:
    sum of 1/(rrf_k + rank) over the lists a document appears in; ties by id."""
    v = vector_hits.select("query_id", id_col, F.col("rank").alias("v_rank"))
    kw = keyword_hits.select("query_id", id_col, F.col("rank").alias("k_rank"))
    j = v.join(kw, ["query_id", id_col], "full")
    rrf = (F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col("v_rank")), F.lit(0.0))
           + F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col("k_rank")), F.lit(0.0)))
    s = j.select("query_id", id_col, "v_rank", "k_rank", F.round(rrf, 8).alias("rrf"))
    return top_k_per(s, "query_id", [F.col("rrf").desc(), F.col(id_col)], k, rank_col="rank")


# K17 ----------------------------------------------------------------------
def passage_matches(docs: DataFrame, passages: DataFrame, w: int = 3, id_col: str = "doc_id",
                    text_col: str = "content") -> DataFrame:
    """Documents whose token sequence contains a passage's token sequence.

    Candidates come from an equi join on the hash of the passage's first
    ``w`` tokens against every ``w``-token window of every document (the
    passages are the small side), then each candidate is verified on the
    whole token sequences. Passages shorter than ``w`` tokens are matched on
    windows of their own length."""
    pt = passages.select("query_id", "tenant_id", simple_tokens("query_text").alias("ptok"))
    pt = pt.filter(F.size("ptok") > 0).withColumn("pw", F.least(F.size("ptok"), F.lit(w)))
    pkey = pt.select("query_id", "tenant_id", "ptok", "pw", F.array_join(F.slice("ptok", 1, F.col("pw")), " ").alias("key"))
    dt = docs.select("tenant_id", id_col, simple_tokens(text_col).alias("dtok"))
    sizes = [r["pw"] for r in pkey.select("pw").distinct().collect()]   # at most w small integers
    cands = None
    for s in sizes:
        # the window keys are built inside the row (linear in the text) and
        # only the keys are exploded; the token array is not copied per row
        keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size("dtok") - s + 1, F.lit(1))),
                           lambda i: F.array_join(F.slice("dtok", i, s), " "))
        win = dt.select("tenant_id", id_col, F.explode(keys).alias("key"))
        c = win.join(lookup(pkey.filter(F.col("pw") == s)), ["tenant_id", "key"], "inner") \
            .select("query_id", "tenant_id", id_col, "ptok")
        cands = c if cands is None else cands.unionByName(c)
    if cands is None:
        return passages.sparkSession.createDataFrame([], f"query_id long, {id_col} long")
    # Candidates are few (a passage's first words rarely recur); written once,
    # Spark broadcasts them if their bytes allow, so the documents' token arrays
    # are checked where they lie instead of being shuffled to the candidates.
    cands = lookup(cands.dropDuplicates(["query_id", id_col]))
    cands = dt.drop("tenant_id").join(cands, id_col, "inner")
    ok = F.contains(F.concat(F.lit(" "), F.array_join("dtok", " "), F.lit(" ")),
                    F.concat(F.lit(" "), F.array_join("ptok", " "), F.lit(" ")))
    return cands.filter(ok).select("query_id", id_col)


def evaluate(hits: DataFrame, expected: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Per question, number of expected documents, hits among the top k,
    recall@k, reciprocal rank of the first expected hit, and whether the
    question has an answer at all."""
    e = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    h = hits.filter(F.col("rank") <= k).join(expected.withColumn("_hit", F.lit(1)), ["query_id", id_col], "inner") \
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("rank").alias("first_rank"))
    out = questions.select("query_id").join(e, "query_id", "left").join(h, "query_id", "left")
    ne = F.coalesce("n_expected", F.lit(0))
    nf = F.coalesce("n_found", F.lit(0))
    return out.select(
        "query_id", ne.alias("n_expected"), nf.alias("n_found"),
        F.when(ne > 0, F.round(nf / ne, 6)).alias("recall_at_k"),
        F.when(ne > 0, F.coalesce(F.round(F.lit(1.0) / F.col("first_rank"), 6), F.lit(0.0))).alias("reciprocal_rank"),
        (ne > 0).alias("answerable"))


def summarise_evaluation(evals: DataFrame, questions: DataFrame, tenants: DataFrame) -> DataFrame:
    """Per sector and over all (``sector`` NULL): questions, the share
    with an answer in the corpus, mean recall@k and mean reciprocal rank of
    those, and the share of them whose answer is contained in the top k."""
    sector = tenants.select("tenant_id", "sector")
    j = evals.join(questions.select("query_id", "tenant_id"), "query_id").join(lookup(sector), "tenant_id", "left")
    known = F.col("answerable")
    return j.rollup("sector").agg(
        F.grouping("sector").cast("int").alias("overall"), F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(known.cast("double")), 4).alias("answerable_share"),
        F.round(F.avg(F.when(known, F.col("recall_at_k"))), 4).alias("recall_at_k"),
        F.round(F.avg(F.when(known, F.col("reciprocal_rank"))), 4).alias("mrr"),
        F.round(F.avg(F.when(known, (F.col("n_found") > 0).cast("double"))), 4).alias("contained_share"))


# S2 -----------------------------------------------------------------------
def _kb_raw(spark: SparkSession, path: str, fmt: str, schema: str | None) -> DataFrame:
    """(source, text, _bad) of every file below ``path``, in folders of any depth."""
    r = spark.read.option("recursiveFileLookup", "true")
    bad = F.lit(None).cast("string").alias("_bad")
    if fmt in ("text", "md", "markdown", "html"):
        return r.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"), bad)
    if fmt == "csv":
        raw = r.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        return raw.select(F.input_file_name().alias("source"), rows_text(raw.columns).alias("text"), bad)
    if fmt == "json":
        if schema is None:
            fields = [f for f in r.json(path).schema.fields if f.name != "_corrupt_record"]
        else:
            fields = list(T._parse_datatype_string(schema).fields)
        full = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
        rec = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        raw = r.text(path).select(F.input_file_name().alias("_source"), rec.alias("_rec")).select("_source", "_rec.*")
        return raw.select(F.col("_source").alias("source"), rows_text([f.name for f in fields]).alias("text"),
                          F.col("_corrupt_record").alias("_bad"))
    raise ValueError(f"unknown format {fmt!r}")


def _kb_tenant() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("source", r"tenants/([^/=]+)/", 1), F.lit("")),
                      F.nullif(F.regexp_extract("source", r"tenant_id=([^/]+)/", 1), F.lit("")))


def read_kb_files(spark: SparkSession, path: str, fmt: str = "text", schema: str | None = None) -> DataFrame:
    """A folder of knowledge files, with folders inside it, to (tenant_id,
    title, source, text). The tenant comes from a ``tenants/{id}/`` storage
    key in the path. Text, Markdown and HTML files are read whole; CSV rows
    and JSON records become one text each (``col: value`` pairs). JSON lines
    that do not parse (or do not fit ``schema``) are left to
    ``kb_rejects``."""
    return _kb_raw(spark, path, fmt, schema).filter("_bad is null").select(
        _kb_tenant().alias("tenant_id"), F.regexp_extract("source", r"([^/]+?)(\.[^./]*)?$", 1).alias("title"), "source", "text")


def kb_rejects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The JSON lines that ``read_kb_files`` leaves out: (tenant_id, source, line)."""
    return _kb_raw(spark, path, "json", schema).filter("_bad is not null").select(
        _kb_tenant().alias("tenant_id"), "source", F.col("_bad").alias("line"))


# S3 -----------------------------------------------------------------------
def rows_text(cols: list[str]) -> Column:
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in cols])


def rows_to_chunks(df: DataFrame, title_col: str, cols: list[str]) -> DataFrame:
    """S3: each row of a structured table (menu, fees, departments) becomes
    one atomic chunk ``col: value; ...`` titled by ``title_col``; NULL
    fields are left out."""
    return df.select("tenant_id", F.col(title_col).cast("string").alias("title"),
                     rows_text(cols).alias("chunk"), content_key(*cols).alias("chunk_key"))


# U2 -----------------------------------------------------------------------
def union_knowledge(chunks: DataFrame, qa: DataFrame, rows: DataFrame) -> DataFrame:
    """Document chunks, Q&A chunks and structured-row chunks as one
    searchable set with a ``kind`` column; missing columns become NULL."""
    return (chunks.withColumn("kind", F.lit("document"))
            .unionByName(qa.withColumn("kind", F.lit("qa")), allowMissingColumns=True)
            .unionByName(rows.withColumn("kind", F.lit("row")), allowMissingColumns=True))

