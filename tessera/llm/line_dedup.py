"""Operator 12: line dedup by range-partitioned hashes.

Every line gives a row of hashes: its key (128 bits), its document (128 bits
of id and text) and its place. The rows are spread by ranges of (key,
document) and sorted by key, document and place inside their partition, so
the lines of one key follow each other, documents in order, first
occurrences first. A task streams over them and decides a key as soon
as enough documents have been seen; it holds at most the rows of the documents before
that. A key with a third of all lines spans many partitions: each of them
counts its own documents (no document of a key is in two partitions), and the
counts of the keys at partition ends, at most two per partition, are summed.

What comes back is one compressed bitmap per document with dropped lines,
never text; ``drop_lines`` applies it to a document's own text.

Rows with equal id and text are one document hash with a weight, the number of rows,
so nothing depends on how or how often Spark evaluates the input.

Defined cases: null text counts as empty, and an empty text is one empty
line; lines without a key (white space only, under ``min_chars``) always stay; a line twice in one document
counts once; rows that repeat an id count each; of equal first occurrences
(``keep="first"``) the lowest document hash has the line; an empty table gives
an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize, slices, text_of, tidy

MIN_DOCS = 10
MIN_CHARS = 1
WHITE = " \t\n\x0b\x0c\r"
DOC = ["_d1", "_d2"]
KEY = ["_k1", "_k2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _doc_hash(id_col: str) -> list[Column]:
    """128 bits of (id, text)."""
    return [F.xxhash64(F.lit(salt), F.col(id_col).isNull(), F.col(id_col), F.col("_text")).alias(name) for salt, name in zip(("a", "b"), DOC)]


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_k1, _k2, _d1, _d2, _pos, _rows) per distinct line of a document; ``_rows`` of equal documents."""
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    lines = base.select(*_doc_hash("_id"), F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = lines.select(*DOC, "_pos", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= max(min_chars, 1))
    return keyed.select(*[F.xxhash64(F.lit(s), "_key").alias(n) for s, n in zip(("a", "b"), KEY)], *DOC, "_pos") \
                .groupBy(*KEY, *DOC, "_pos").agg(F.count(F.lit(1)).alias("_rows"))


# ---- the stream --------------------------------------------------------------

DROP, COUNT, OPEN, LEAD = range(4)
FOUND = ["_kind", *KEY, *DOC, "_pos", "_n"]


class _Run:
    """The rows of one key in one partition. ``held`` are those that wait for the decision;
    ``lead`` is the first of them where the first occurrence stays."""

    __slots__ = ("key", "starts", "docs", "doc", "held", "lead")

    def __init__(self, key: tuple, starts: bool):
        self.key, self.starts, self.docs, self.doc, self.held, self.lead = key, starts, 0, None, [], None


def stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Sorted line rows to rows of FOUND. ``DROP``: a line that goes. For the
    keys at the partition's ends, which other partitions may share:
    ``COUNT`` (documents seen here), ``OPEN`` (a line that goes if all of them
    together have enough) and ``LEAD`` (likewise, but the first of all leads stays)."""
    run, out = None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(FOUND), FOUND)
        out.clear()
        return batch

    def close(ends: bool) -> None:
        if run.starts or ends:
            out.append((COUNT, *run.key, 0, 0, 0, run.docs))
            out.extend((OPEN, *run.key, *row, 0) for row in run.held)
            if run.lead is not None:
                out.append((LEAD, *run.key, *run.lead, 0))

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, d1, d2, pos, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        first = np.concatenate([[0], np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1])
        after = np.concatenate([first[1:], [batch.num_rows]])
        # a key wholly inside the batch with too few rows can't have enough documents
        look = np.add.reduceat(weight, first) >= min_docs
        look[0] = look[-1] = True
        for a, b in zip(first[look].tolist(), after[look].tolist()):
            key = (int(k1[a]), int(k2[a]))
            if run is None or run.key != key:
                if run is not None:
                    close(False)
                run = _Run(key, run is None)
            e1, e2 = d1[a:b], d2[a:b]
            fresh = np.ones(b - a, bool)
            fresh[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
            fresh[0] = run.doc != (int(e1[0]), int(e2[0]))
            run.doc = (int(e1[-1]), int(e2[-1]))
            run.docs += int(weight[a:b][fresh].sum())
            rows = list(zip(e1.tolist(), e2.tolist(), pos[a:b].tolist()))
            if keep_first and run.lead is None:
                run.lead = rows.pop(0)
            run.held += rows
            if run.docs >= min_docs:
                out.extend((DROP, *key, *row, 0) for row in run.held)
                run.held = []
        if len(out) >= 50_000:
            yield flush()
    if run is not None:
        close(True)
    yield flush()


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """(_d1, _d2, keep_bitmap, n_dropped) per document hash with dropped lines: the lines
    whose key at least ``min_docs`` documents have. ``keep="first"`` spares
    each key's first occurrence, in the order of the document hashes."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    rows = line_rows(docs, id_col, text_col, min_chars)
    order = [*KEY, *DOC]
    found = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order, "_pos")
                        .mapInArrow(tidy(lambda batches: stream(batches, min_docs, keep == "first")),
                                    ", ".join(f"{c} long" for c in FOUND)))
    line = [*DOC, "_pos"]
    everywhere = found.filter(F.col("_kind") == COUNT).groupBy(*KEY).agg(F.sum("_n").alias("_docs")).filter(F.col("_docs") >= min_docs)
    opened = found.filter(F.col("_kind") == OPEN).join(everywhere, KEY, "left_semi").select(*line)
    leads = found.filter(F.col("_kind") == LEAD).join(everywhere, KEY, "left_semi")
    spared = leads.groupBy(*KEY).agg(F.min(F.struct(*line)).alias("_first"))
    later = leads.join(spared, KEY).filter(F.struct(*line) != F.col("_first")).select(*line)
    gone = found.filter(F.col("_kind") == DROP).select(*line).unionByName(opened).unionByName(later)
    places = gone.groupBy(*DOC).agg(F.collect_list(F.col("_pos").cast("int")).alias("_places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for p in batch.column("_places"):
                at = p.values.to_numpy(zero_copy_only=False)
                stays = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                stays[at] = False
                maps.append(zlib.compress(np.packbits(stays, bitorder="little").tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in DOC], pa.array(maps, pa.binary()), pa.array(counts, pa.int64())],
                                             [*DOC, "keep_bitmap", "n_dropped"])

    return places.mapInArrow(tidy(pack), "_d1 long, _d2 long, keep_bitmap binary, n_dropped long")


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    """The lines whose bit is set; lines beyond the bitmap stay."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").tolist()
    return [x for x, bit in zip(lines, bits) if bit] + lines[len(bits):]


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_lines, n_dropped, text) per row of ``docs`` with its kept lines joined;
    ``digest`` gives kept_sha256 in place of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = "kept_sha256" if digest else "text"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                counts, texts = [], []
                for text, bitmap in zip(part.column("_text").to_pylist(), part.column("keep_bitmap").to_pylist()):
                    lines = text.split("\n")
                    counts.append(len(lines))
                    kept = "\n".join(kept_lines(lines, bitmap))
                    texts.append(hashlib.sha256(kept.encode()).hexdigest() if digest else kept)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(counts, pa.int64()), part.column("n_dropped"), pa.array(texts, pa.string())],
                                                 [id_col, "n_lines", "n_dropped", last])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    met = base.select("*", *_doc_hash("_id")).join(bitmaps, DOC, "left") \
              .select("_id", "_text", "keep_bitmap", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return met.mapInArrow(tidy(render), f"`{id_col}` {kind}, n_lines long, n_dropped long, {last} string")


ORACLE_SQL = """
    WITH d AS (SELECT row_number() OVER () AS u, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT u, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT u) >= 10),
    j AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM j GROUP BY u"""
