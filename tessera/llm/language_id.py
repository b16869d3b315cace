"""Operator 1: language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. One linear classifier per bit is
trained over hashed byte n-grams (logistic loss, numpy). A text's margins are
decoded to the codeword with the smallest loss, each bit weighted by how well its
classifier tells that language in training. A text's distance from its codeword
counts a bit 0 where its margin is as large as usual in training, a half at zero
margin and 1 where it is as large on the wrong side. From ``FAR`` of the smallest distance of
the code on, the second codeword is about as near (at a half it may be nearer) and the text is flagged as ambiguous. Texts in a language or script
that was never learned have small margins and lie outside.

Training takes at most ``sample_docs`` labelled documents (whole texts), the same
number of each language as far as there are, chosen by a hash of the id; rows that repeat an id and a language count as
one. Prediction reads
every text whole, in one map without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and not
ambiguous; rows with a null id or a null language are never learned from;
if nothing can be learned every text is ``und``; with one learned language every text with a
letter has that language and score 1; repeated rows give repeated rows; an empty table gives an empty
result; of equal losses the language first in order wins; other columns are never read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import release_memory, remainder, slices, text_of, tidy

DIM_BITS = 13
ORDERS = (2, 3, 4)
SAMPLE_DOCS = 1000
FAR = 0.4
UND = "und"
LETTER = re.compile(r"[^\W\d_]")

# Bytes that aren't letters become a space; runs of spaces count once.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_MIX = np.uint32(2654435761)


def ngram_counts(text: str) -> np.ndarray:
    """Relative counts of the text's hashed byte n-grams (each order sums to 1)."""
    b = _CLASS[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    space = b == 0x20
    b = b[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    out = np.zeros(1 << DIM_BITS, np.float32)
    code = b.copy()
    for n in range(2, max(ORDERS) + 1):
        if b.size < n:
            break
        code = (code[:b.size - n + 1] << np.uint32(8)) | b[n - 1:]
        if n in ORDERS:
            slot = ((code + np.uint32(n * 0x9E37)) * _MIX) >> np.uint32(32 - DIM_BITS)
            out += np.bincount(slot, minlength=1 << DIM_BITS).astype(np.float32) / slot.size
    return out


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``k`` languages as rows of +1/-1: all two-way splits up to 7
    languages, else the best of 200 seeded random codes of 10 log2(k) bits by its smallest distance."""
    if k <= 7:
        return np.array([[1 if i == 0 or s[i - 1] else -1 for s in itertools.product([0, 1], repeat=k - 1) if not all(s)]
                         for i in range(k)], np.float32).reshape(k, -1)
    rnd, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rnd.choice(np.array([-1, 1], np.float32), (k, width))
        m = m[:, np.abs(m.sum(0)) < k]
        gap = min_distance(m)
        if best is None or gap > best[0]:
            best = gap, m
    return best[1]


def min_distance(code: np.ndarray) -> int:
    d = (code.shape[1] - code @ code.T) / 2
    return int((d + np.eye(len(code)) * 1e9).min()) if len(code) > 1 else 0


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray          # languages x bits
    weights: np.ndarray       # slots x bits
    bias: np.ndarray
    trust: np.ndarray         # languages x bits, rows sum to the number of bits
    usual: np.ndarray | float = 1.0         # median margin of each bit in training

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) per row of margins."""
        loss = np.einsum("kb,nkb->nk", self.trust, np.logaddexp(0, -self.code[None] * margins[:, None, :]))
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / p.sum(1)
        return best, score, self.distance(margins, best) >= FAR * max(1, min_distance(self.code))

    def distance(self, margins: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Distance in bits from the codeword, by the size of the margins."""
        return np.clip(1 - self.code[word] * margins / self.usual, 0, 2).sum(1) / 2

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias


def fit(features: np.ndarray, labels: list[str], steps: int = 120, rate: float = 0.3, ridge: float = 1e-4) -> LanguageModel:
    """All bit classifiers at once by full-batch Adam on the balanced logistic loss."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    code = code_matrix(len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((features.shape[1], 0), np.float32), np.zeros(0, np.float32), np.zeros(code.shape, np.float32))
    scale = 1 / np.sqrt(features.mean(0) + 1e-5)
    x = (features * scale).astype(np.float32)
    target = code[y]
    weight = (1 / np.bincount(y))[y][:, None] * np.ones_like(target)
    for b in range(code.shape[1]):
        for side in (-1, 1):
            at = target[:, b] == side
            weight[at, b] /= 2 * weight[at, b].sum()
    weight = weight.astype(np.float32)
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
    for t in range(1, steps + 1):
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30)))
        gw, gb = x.T @ g + ridge * w, g.sum(0)
        for p, q, r, s in ((w, gw, m, v), (bias, gb, mb, vb)):
            r += 0.1 * (q - r)
            s += 0.001 * (q * q - s)
            p -= rate * (r / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-6)
    agrees = (x @ w + bias) * target
    trust = np.stack([(agrees[y == k] > 0).mean(0) for k in range(len(langs))])
    trust = np.maximum(trust - 0.5, 0.01)
    trust *= code.shape[1] / trust.sum(1, keepdims=True)
    usual = np.maximum(np.median(agrees, axis=0), 1e-6)
    return LanguageModel(langs, code, (w * scale[:, None]).astype(np.float32), bias, trust.astype(np.float32), usual.astype(np.float32))


def sample_ids(labelled: DataFrame, id_col: str, label_col: str, n: int) -> list:
    """At most ``n`` (id, label) pairs, the same number of each label as far as
    there are, by a hash of the id. Labels are counted first (a map-side combine); of a label
    only the ids whose hash lies in its lowest share, about 3 n of them, are ranked, so
    no task meets a number of rows that grows with the table."""
    counts = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(3.0 * n + 100) / F.col("_n"))
    spread = F.pmod(F.xxhash64(id_col), F.lit(1 << 52)) / F.lit(float(1 << 52))
    low = (labelled.select(id_col, label_col).join(F.broadcast(counts), label_col)     # one row per label
                   .withColumn("_h", spread).filter(F.col("_h") <= share))
    ranked = low.withColumn("_rn", F.row_number().over(Window.partitionBy(label_col).orderBy("_h", id_col))).filter(F.col("_rn") <= n)
    return [(r[0], r[1]) for r in ranked.orderBy("_rn", "_h", label_col).limit(n).select(id_col, label_col).collect()]


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, _text): one row per key, whose text is the same however the rows are dealt; one that isn't empty if there is any.
    Rows of a key are combined in their own tasks first, so a repeated key is never gathered."""
    best = F.max(F.struct((F.col("_text") != "").alias("_some"), F.xxhash64("_text").alias("_h"), "_text"))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best._text").alias("_text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          folds: int = 5, held_out: int = 0, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns from documents with a language whose crc32(id) mod ``folds`` isn't ``held_out``."""
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_lang"), text_of(f"`{text_col}`").alias("_text"))
    known = base.filter(F.col("_lang").isNotNull() & (remainder("_id", folds) != held_out))
    pairs = known.select("_id", "_lang").distinct()
    chosen = sample_ids(pairs, "_id", "_lang", sample_docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = [(np.flatnonzero(f).astype(np.uint16), f) for f in map(ngram_counts, part.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_lang"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([f[i].tobytes() for i, f in rows], pa.binary())],
                    ["lang", "slots", "shares"])

    has_letter = F.col("_text").rlike(r"\p{L}")
    got = None
    if chosen:
        wanted = docs.sparkSession.createDataFrame(chosen, pairs.schema)      # at most sample_docs rows
        some = known.filter(has_letter).join(F.broadcast(wanted), ["_id", "_lang"], "left_semi")
        got = one_text(some, "_id", "_lang").select("_lang", "_text").mapInArrow(features, "lang string, slots binary, shares binary").toArrow()
    if got is None or not got.num_rows:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros((1 << DIM_BITS, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32))
    rows = sorted(zip(*[got.column(c).to_pylist() for c in ("lang", "slots", "shares")]))
    x = np.zeros((len(rows), 1 << DIM_BITS), np.float32)
    for i, (_, slots, shares) in enumerate(rows):
        x[i, np.frombuffer(slots, np.uint16)] = np.frombuffer(shares, np.float32)
    model = fit(x, [r[0] for r in rows])
    del got, rows, x
    release_memory()
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, ambiguous) per row; with ``keep`` the named columns instead of the id."""
    fields = [docs.schema[c] for c in (keep or [id_col])]
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2**DIM_BITS weights per bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                lang, score, unsure = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                at = [i for i, t in enumerate(texts) if m.langs and LETTER.search(t)]
                for k in range(0, len(at), 64):
                    some = at[k:k + 64]
                    best, p, a = m.decode(m.margins(np.stack([ngram_counts(texts[i]) for i in some])))
                    score[some], unsure[some] = p, a
                    for i, j in zip(some, best):
                        lang[i] = m.langs[j]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure)],
                                                 [*part.schema.names[:-1], "_lang_pred", "_score", "_ambiguous"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
    schema = StructType([*[StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)],
                         StructField("_lang_pred", StringType()), StructField("_score", DoubleType()), StructField("_ambiguous", BooleanType())])
    base = docs.select(*[F.col(f"`{f.name}`").alias(f"_k{i}") for i, f in enumerate(fields)], text_of(f"`{text_col}`").alias("_text"))
    names = [f.name for f in fields] + ["lang_pred", "score", "ambiguous"]
    return base.mapInArrow(tidy(run), schema).toDF(*names)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                folds: int = 5, held_out: int = 0, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Trains on the learnable rows of ``docs`` and predicts all: (id, held_out, lang_pred, score, ambiguous)."""
    model = train(docs, id_col, text_col, label_col, folds, held_out, sample_docs)
    return identify(docs, model, id_col, text_col).select(
        id_col, F.coalesce(remainder(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or ambiguous, columns as they were."""
    names = docs.columns
    out = identify(docs, model, text_col=text_col, keep=names)
    flagged = out.toDF(*[f"_c{i}" for i in range(len(names))], "_lang", "_score", "_amb")
    return flagged.filter((F.col("_lang") != UND) & ~F.col("_amb")).select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
