"""Operator 8: document scores by masked pseudo-likelihood.

A token is a character class: the corpus's most frequent characters (upper and lower case alike), a line end, white space, digits, other
signs, and ten classes over which all other letters of every script are spread by a hash, so a text in any script has tokens that differ. A small network sees two tokens on each side of a
masked token and gives the probability of every class there; a document's score is the sum of
log-probabilities of its tokens, each predicted from both sides.

Training follows the whole corpus: the characters of all documents are counted for the
alphabet, then all five-token windows, combined per task and summed by Spark. The summed windows
are the training data, dealt by context to SHARDS shards. Rounds of local training run on the shards (numpy, minibatches with Adam): each round
passes over every window of the shard, with the weight of its count, frequent ones in several parts. The parameters
are averaged by weight after each round; only the parameters (a few tens
of KB per shard) go through the driver. A shard holds the same windows however rows are dealt to tasks, so the network doesn't depend on
partitions. As a context has four tokens of 32 classes, a worker
evaluates the network once for each of the 2**20 contexts and scores whole texts by looking their windows up.

Defined cases: a null text counts as empty; an empty text has 0 tokens and score 0; past the ends of
a text stands a border class; on a corpus without a token every class is equally likely; repeated rows give repeated rows (and weigh as
often); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize, slices, text_of

CLASSES = 32
BORDER, LETTER, DIGIT, SIGN, SPACE, LINE = range(6)
FIRST_HASHED, HASHED = 6, 10        # classes shared by the letters without one of their own
FIRST_CHAR = FIRST_HASHED + HASHED
SIDE = 2
EMBED, HIDDEN = 8, 32
ROUNDS, LOCAL_STEPS, BATCH, RATE = 5, 120, 1024, 0.01      # LOCAL_STEPS at least; a pass over all windows may take more
SHARDS = 8
POINTS = 0x30000          # code points with a class of their own table entry; all above are signs


def kind_table() -> np.ndarray:
    """Code point -> LETTER, DIGIT, SIGN, SPACE or LINE."""
    table = np.full(POINTS, SIGN, np.uint8)
    for p in range(0x3000):
        c = chr(p)
        table[p] = LINE if c in "\n\r" else SPACE if c.isspace() else DIGIT if c.isdigit() else LETTER if c.isalpha() else SIGN
    table[0x3000], table[0x3001:0xA000], table[0xAC00:0xD7A4], table[0x20000:] = SPACE, LETTER, LETTER, LETTER
    return table


def class_table(chars: list[str]) -> np.ndarray:
    """Code point -> class, given the characters with a class of their own."""
    table = kind_table()
    letters = np.flatnonzero(table == LETTER)
    table[letters] = FIRST_HASHED + (letters.astype(np.uint64) * 2654435761 % (1 << 32) >> 20) % HASHED
    for k, c in enumerate(chars[:CLASSES - FIRST_CHAR]):
        table[ord(c)] = FIRST_CHAR + k
    return table


def points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32), POINTS - 1)


def windows(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows around every token of the texts, and the tokens of each text. The
    centre has the lowest bits: code = context * CLASSES + centre."""
    codes = [points(t) for t in texts]
    counts = np.array([c.size for c in codes], np.int64)
    pad = np.full(SIDE, BORDER, np.uint8)
    flat = np.concatenate([x for c in codes for x in (pad, table[c])] + [pad]).astype(np.uint32)
    n = flat.size - 2 * SIDE
    code = np.zeros(n, np.uint32)
    for k in (0, 1, 3, 4):
        code = code * np.uint32(CLASSES) + flat[k:k + n]
    code = code * np.uint32(CLASSES) + flat[SIDE:SIDE + n]
    real = np.ones(n, bool)                        # the borders between texts are no tokens
    ends = np.cumsum(counts + SIDE)[:-1] - SIDE
    for k in range(SIDE):
        real[ends + k] = False
    return code[real], counts


@dataclass
class WindowNetwork:
    """One hidden layer over the embeddings of a window's outer tokens."""
    chars: list[str]
    embed: np.ndarray         # places x classes x EMBED
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    _scores: np.ndarray | None = field(default=None, repr=False, compare=False)

    @classmethod
    def start(cls, chars: list[str], seed: int = 11) -> WindowNetwork:
        r = np.random.default_rng(seed)
        places = 2 * SIDE
        return cls(chars, r.normal(0, 0.3, (places, CLASSES, EMBED)).astype(np.float32),
                   r.normal(0, (places * EMBED) ** -0.5, (places * EMBED, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                   np.zeros((HIDDEN, CLASSES), np.float32), np.zeros(CLASSES, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2]

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, hidden, log-probabilities) of context codes."""
        places = self.embed.shape[0]
        x = np.concatenate([self.embed[k, context >> (5 * (places - 1 - k)) & 31] for k in range(places)], 1)
        h = np.tanh(x @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2
        z -= z.max(1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def scores(self) -> np.ndarray:
        """log-probability by window code, for all contexts; computed once."""
        if self._scores is None:
            out = np.empty((1 << 20, CLASSES), np.float32)
            for a in range(0, 1 << 20, 1 << 14):
                out[a:a + (1 << 14)] = self.forward(np.arange(a, a + (1 << 14)))[2]
            self._scores = out.reshape(-1)
        return self._scores

    def train(self, codes: np.ndarray, counts: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam steps over all windows at least once: a window whose count is more than a ``steps * batch``-th of
        all comes in several equal parts, so each has its weight and none is left out."""
        rnd = np.random.default_rng(seed)
        parts = np.ceil(counts * (steps * batch / counts.sum())).astype(np.int64)
        order = rnd.permutation(np.repeat(np.arange(codes.size), parts))
        share = counts / parts
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        places = self.embed.shape[0]
        for t, a in enumerate(range(0, order.size, batch), 1):
            at = order[a:a + batch]
            code, weight = codes[at], (share[at] / share[at].sum()).astype(np.float32)[:, None]
            context, centre = code // CLASSES, code % CLASSES
            x, h, logp = self.forward(context)
            dz = np.exp(logp)
            dz[np.arange(at.size), centre] -= 1
            dz *= weight
            dh = (dz @ self.w2.T) * (1 - h * h)
            dx = dh @ self.w1.T
            de = np.zeros_like(self.embed)
            for k in range(places):
                np.add.at(de[k], context >> (5 * (places - 1 - k)) & 31, dx[:, k * EMBED:(k + 1) * EMBED])
            for (p, m, v), g in zip(state, (de, x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)


# ---- what is gathered from the corpus ---------------------------------------------

def alphabet(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent visible characters of all documents (ties by code point)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(POINTS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in part.column("_text").to_pylist():
                    n = np.bincount(points(t))
                    total[:n.size] += n
        at = np.flatnonzero(total[:POINTS - 1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["point", "n"])

    counts = docs.select(text_of(f"`{text_col}`").alias("_text")).mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    plain = kind_table()
    rows = counts.collect()             # at most POINTS rows
    own = [(r["n"], r["point"]) for r in rows if plain[r["point"]] in (LETTER, SIGN)]
    return [chr(p) for _, p in sorted(own, key=lambda x: (-x[0], x[1]))[:CLASSES - FIRST_CHAR]]


def window_counts(docs: DataFrame, chars: list[str], text_col: str = "text") -> DataFrame:
    """(code, n): how often each window stands in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = class_table(chars), [], 0

        def merge(parts):
            codes = np.concatenate([c for c, _ in parts])
            n = np.concatenate([k for _, k in parts])
            found, inverse = np.unique(codes, return_inverse=True)
            return found, np.bincount(inverse, weights=n, minlength=found.size).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                code, _ = windows(part.column("_text").to_pylist(), table)
                if code.size:
                    held.append(np.unique(code, return_counts=True))
                    size += held[-1][0].size
                if size > 2_000_000:
                    held = [merge(held)]
                    size = 0
        if held:
            codes, n = merge(held)
            for a in range(0, codes.size, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[a:a + 100_000], pa.int64()), pa.array(n[a:a + 100_000], pa.int64())], ["code", "n"])

    return (docs.select(text_of(f"`{text_col}`").alias("_text")).mapInArrow(run, "code long, n long")
                .groupBy("code").agg(F.sum("n").alias("n")))


def shard_of(code: Column) -> Column:
    """Windows of one context are in one shard."""
    return F.pmod(F.xxhash64(F.floor(code / CLASSES).cast("long")), F.lit(SHARDS)).cast("int")


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, steps: int = LOCAL_STEPS) -> WindowNetwork:
    """Trains on the windows of all documents; the result doesn't depend on how rows are dealt to tasks."""
    chars = alphabet(docs, text_col)
    dealt = window_counts(docs, chars, text_col).withColumn("shard", shard_of(F.col("code")))
    counts = materialize(dealt.repartition(SHARDS, "shard"))
    net = WindowNetwork.start(chars)
    for r in range(rounds):
        rate = RATE / (1 + r)
        now = net

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
            if not parts:
                return
            codes, n, shard = (np.concatenate(x) for x in zip(*parts))
            for s in np.unique(shard).tolist():
                mine = shard == s
                order = np.argsort(codes[mine])
                own, weight = codes[mine][order], n[mine][order]
                copy = WindowNetwork(now.chars, *[p.copy() for p in now.params()])
                copy.train(own, weight, steps, BATCH, rate, seed=100 * s + r)
                flat = np.concatenate([p.ravel() for p in copy.params()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([float(weight.sum())]), pa.array([s], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
                                                 ["weight", "part", "params"])

        # a shard lies in one file, which may be read in pieces: they meet again here
        got = counts.repartition(SHARDS, "shard").mapInArrow(local, "weight double, part long, params binary").collect()
        if not got:
            break
        got.sort(key=lambda x: x["part"])
        mean = np.average([np.frombuffer(x["params"], np.float32) for x in got], axis=0, weights=[x["weight"] for x in got]).astype(np.float32)
        parts, at = [], 0
        for p in net.params():
            parts.append(mean[at:at + p.size].reshape(p.shape))
            at += p.size
        net = WindowNetwork(chars, *parts)
    return net


_SHARED: dict[bytes, WindowNetwork] = {}


def _worker_copy(net: WindowNetwork) -> WindowNetwork:
    """One copy per Python worker, so that its table is computed once."""
    key = net.w2.tobytes() + net.b2.tobytes()
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = net
    return _SHARED[key]


def score(docs: DataFrame, net: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, pll, mean_pll) per row: the summed log-probability of the whole text, and per token."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)      # the parameters; their number is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_copy(shared.value)
        table, logp = class_table(model.chars), model.scores()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                code, counts = windows(part.column("_text").to_pylist(), table)
                total = np.concatenate([[0.0], np.cumsum(logp[code], dtype=np.float64)])
                ends = np.cumsum(counts)
                pll = total[ends] - total[ends - counts]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(counts), pa.array(pll), pa.array(pll / np.maximum(counts, 1))],
                                                 [id_col, "n_tokens", "pll", "mean_pll"])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    return base.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, pll double, mean_pll double")


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, steps: int = LOCAL_STEPS) -> DataFrame:
    """Trains on all documents and scores all of them."""
    return score(docs, train(docs, text_col, rounds, steps), id_col, text_col)
