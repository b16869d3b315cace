"""Operator 9: toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and their stems (first 3 to 5 letters), hashed to 62 bits. The machine

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

learns a weight per term and, through short factor vectors, the effect of two
terms that stand together, such as an insult with a mention of a group, which
a sum of single weights misses. Its terms are all those of the sample that the labels speak for, alone or
in a pair: terms whose share of label 1 differs from the sample's by ``MIN_Z`` standard errors, and words of
pairs whose documents' residuals, after the single weights, lie ``PAIR_Z`` standard errors beyond those of either
word's documents. Both bounds lie where chance alone gives a handful of terms; there is no cap on
their number. A term that says nothing alone is kept if a pair needs it.

Training takes at most ``sample_docs`` labelled documents (whole texts), as many of each label as far as there
are, chosen by a hash of the id. Scoring reads every text whole, in one map without a shuffle.

Defined cases: a text that is null, empty or has no word is scored by w0
alone; labels that are null are ignored, of several labels of a document the largest counts; a
document without an id is never learned from; of rows that repeat an id one is learned from; if the sample lacks either label every score is the sample's
share of label 1 (0 for none); repeated rows give repeated rows; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .language_id import one_text, sample_ids
from .util import release_memory, remainder, slices, text_of, tidy

SAMPLE_DOCS = 3000
MIN_Z = 4.0              # chance alone gives one term in 16,000 this much
PAIR_Z = 6.0             # and one pair in 500 million this
TILE = 512
FACTORS = 6
THRESHOLD = 0.7
STEMS = (3, 4, 5)
CACHE_WORDS = 60_000
WORDS = re.compile(r"\w+")


def word_terms(word: str) -> list[int]:
    """Hashed terms of one lower-case word."""
    stems = [xxhash.xxh3_64_intdigest(f"{n}{word[:n]}") >> 2 << 1 for n in STEMS if len(word) > n]
    return [xxhash.xxh3_64_intdigest("w" + word) >> 2 << 1 | 1, *stems]          # words are odd, stems even


def text_terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    found = {t for w in set(WORDS.findall(text.lower())) for t in word_terms(w)}
    return np.array(sorted(found), np.int64)


@dataclass
class ToxicityModel:
    terms: np.ndarray        # sorted hashes with a weight
    w0: float
    w: np.ndarray
    v: np.ndarray            # terms x factors

    def margin(self, rows: np.ndarray) -> float:
        """The machine's value for a text that has these terms (row numbers)."""
        s = self.v[rows]
        total = s.sum(0)
        return float(self.w0 + self.w[rows].sum() + 0.5 * (total @ total - (s * s).sum()))

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(rows), -35, 35))))


class TermRows(dict):
    """word -> rows of the model that its terms have; a bounded cache."""

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.row = {t: i for i, t in enumerate(terms.tolist())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        rows = tuple(self.row[t] for t in word_terms(word) if t in self.row)
        if len(word) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = rows
        return rows

    def of(self, text: str) -> np.ndarray:
        return np.fromiter({r for rows in map(self.__getitem__, set(WORDS.findall(text.lower()))) for r in rows}, np.int64)


def single_terms(texts: list[np.ndarray], y: np.ndarray, min_z: float = MIN_Z) -> np.ndarray:
    """Terms whose share of label 1 differs from the sample's by ``min_z`` standard errors."""
    terms, n = np.unique(np.concatenate(texts), return_counts=True)
    seen, times = np.unique(np.concatenate([t for t, label in zip(texts, y) if label]), return_counts=True)
    pos = np.zeros(terms.size, np.int64)
    pos[np.searchsorted(terms, seen)] = times
    p, total = y.mean(), len(y)
    error = np.sqrt(n * (total - n + 1e-9) / total * p * (1 - p))
    return terms[np.abs(pos - n * p) >= min_z * np.maximum(error, 1e-9)]


def pair_terms(texts: list[np.ndarray], residual: np.ndarray, pair_z: float = PAIR_Z) -> np.ndarray:
    """Words of pairs whose documents' residuals add up to ``pair_z`` standard errors beyond what the mean residual
    of either word alone explains. As no pair can reach that in fewer than pair_z ** 2
    documents, only words that stand in as many are paired."""
    words, n = np.unique(np.concatenate([t[t & 1 == 1] for t in texts]), return_counts=True)
    words, n = words[n >= pair_z ** 2], n[n >= pair_z ** 2]
    x = _matrix(texts, words)
    r, found = residual.astype(np.float32)[:, None], np.zeros(words.size, bool)
    alone = np.abs((x * r).sum(0)) / np.maximum(n, 1)
    for a in range(0, words.size, TILE):
        part = x[:, a:a + TILE]
        explained = (part.T @ x) * np.maximum(alone[a:a + TILE, None], alone[None, :])
        beyond = np.abs((part * r).T @ x) - explained
        hit = beyond >= pair_z * np.sqrt(np.maximum((part * r * r).T @ x, 1e-30))
        found[a:a + TILE] |= hit.any(1)
        found |= hit.any(0)
    return words[found]


def _matrix(texts: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), terms.size), np.float32)
    for i, t in enumerate(texts):
        at = np.searchsorted(terms, t)
        at = at[terms[np.minimum(at, terms.size - 1)] == t] if terms.size else at[:0]
        x[i, at] = 1
    return x


def _machine(x: np.ndarray, y: np.ndarray, factors: int, steps: int, rate: float, lasso: float, ridge: float, seed: int):
    """(w0, w, v) by full-batch Adam on the balanced logistic loss; an L1 step sets weak single weights to 0."""
    rnd = np.random.default_rng(seed)
    w0, w, v = np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), rnd.normal(0, 0.02, (x.shape[1], factors)).astype(np.float32)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w0, w, v)]
    for t in range(1, steps + 1):
        s = x @ v
        f = w0 + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
        d = ((1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) * weight).astype(np.float32)
        xd = x.T @ d
        grads = (d.sum(keepdims=True), xd, x.T @ (d[:, None] * s) - v * xd[:, None] + ridge * v)
        for (p, m, u), g in zip(state, grads):
            m += 0.1 * (g - m)
            u += 0.01 * (g * g - u)
            p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(u / (1 - 0.99 ** t)) + 1e-6)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
    return w0, w, v


def fit(texts: list[np.ndarray], y: np.ndarray, min_z: float = MIN_Z, pair_z: float = PAIR_Z, factors: int = FACTORS,
        steps: int = 300, rate: float = 0.05, lasso: float = 0.01, ridge: float = 1e-4, seed: int = 3) -> ToxicityModel:
    """Chooses the terms (single weights first, then pairs in what these leave) and trains the machine."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros(0, np.int64), 35.0 * (2 * share - 1), np.zeros(0), np.zeros((0, factors)))
    terms = single_terms(texts, y, min_z)
    x = _matrix(texts, terms)
    w0, w, _ = _machine(x, y, 0, steps // 3, rate, lasso, ridge, seed)
    left = (y - 1 / (1 + np.exp(-np.clip(w0 + x @ w, -30, 30)))) * np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum())     # sums to 0, nearly
    more = np.setdiff1d(pair_terms(texts, left, pair_z), terms)
    if more.size:
        terms = np.union1d(terms, more)
        x = _matrix(texts, terms)
    w0, w, v = _machine(x, y, factors, steps, rate, lasso, ridge, seed)
    return ToxicityModel(terms, float(w0[0]), w.astype(np.float64), v.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learns from labelled documents whose crc32(id) mod ``folds`` isn't ``held_out``."""
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
                   .filter(F.col("_y").isin(0, 1) & (remainder("_id", folds) != held_out)))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    there = known.groupBy("_id").agg(F.max("_y").alias("_y")).join(base.select("_id"), "_id", "left_semi")
    label = dict(sample_ids(there, "_id", "_y", sample_docs))
    if not label:
        return fit([], np.zeros(0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                got = [text_terms(t).tobytes() for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(got, pa.binary())], ["_id", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = one_text(base.filter(F.col("_id").isin(list(label))), "_id").mapInArrow(tidy(features), f"_id {kind}, terms binary").toArrow()
    seen = {(label[i], t) for i, t in zip(got.column("_id").to_pylist(), got.column("terms").to_pylist())}   # copies count once
    del got
    rows = sorted(seen)
    texts, y = [np.frombuffer(t, np.int64) for _, t in rows], np.array([y for y, _ in rows], np.float64)
    del seen, rows
    release_memory()                   # before the matrices are made
    model = fit(texts, y)
    del texts
    release_memory()
    return model


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) and the score of every row."""
    fields = [docs.schema[c] for c in (keep or ["doc_id"])]
    shared = docs.sparkSession.sparkContext.broadcast(model)      # the sample's chosen terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = TermRows(m.terms)
        for batch in batches:
            for part in slices(batch, "_text"):
                score = [m.score(rows.of(t)) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], [*part.schema.names[:-1], "_score"])

    schema = StructType([*[StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)], StructField("_score", DoubleType())])
    base = docs.select(*[F.col(f"`{f.name}`").alias(f"_k{i}") for i, f in enumerate(fields)], text_of(f"`{text_col}`").alias("_text"))
    return base.mapInArrow(tidy(run), schema).toDF(*[f.name for f in fields], "score")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = train(docs, labels, id_col, text_col, label_col, folds, held_out, sample_docs)
    return scored(docs, model, text_col, [id_col]).select(
        id_col, F.coalesce(remainder(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, columns as they were."""
    names = docs.columns
    out = scored(docs, model, text_col, names).toDF(*[f"_c{i}" for i in range(len(names))], "_score")
    return out.filter(F.col("_score") < threshold).select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
