"""Operator 7: BPE encoding by backtracking, decoding by an offset table.

A word is a string of symbols: one per byte, the last one marked as the word's end. An
Aho-Corasick automaton over all tokens gives the longest token at every
position. The encoder takes the longest token that is compatible with the token before
it, else the next shorter one, else steps back over the token before and bars that
position; each position is barred at most once, so a word is encoded in
linear time. Two tokens are compatible if merging their joined text would
give just these two; the answers are kept in a table. The result is exactly that of
applying the merges in rank order. Chunks of text already seen are taken from a
bounded cache.

Decoding gathers the tokens' texts from one byte string by their offsets.

Defined cases: null text counts as empty (0 tokens, digests of the empty
text); texts of any length are encoded whole; strings of special tokens inside a text get
their special ids, as the tokenizers library does; repeated rows give repeated rows; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, text_of, tokenizer_path

CACHE_CHUNKS = 200_000
CACHE_PAIRS = 1_000_000
LATIN = "\u024f"       # the last of the Latin letters with simple rules
# White space as the tokenizers library sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and tables of a word-level BPE file with word ends."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in (vocab | self.special).items():
            self.strings[i] = s
        back = {c: b for b, c in enumerate(byte_chars())}

        def symbols(token: str) -> str | None:
            body = token[:-len(self.end)] if token.endswith(self.end) else token
            if not body or any(c not in back for c in body):
                return None
            s = "".join(chr(back[c]) for c in body)
            return s if body is token else s[:-1] + chr(256 + ord(s[-1]))

        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        for r, m in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            t = vocab[self.strings[a] + self.strings[b]]
            self.halves[t], self.merged[(a, b)], self.rank[t] = (a, b), t, r
        self.length, by_symbols = [0] * size, {}
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s not in self.special and (x := symbols(s)):
                by_symbols[x], self.length[i] = i, len(x)
                self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of each token.
        self.shorter = [-1] * size
        for x, i in by_symbols.items():
            for n in range(len(x) - 1, 0, -1):
                if (j := by_symbols.get(x[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between these two tokens: undoing the merges of both,
        the later first, no pair that meets at the border may merge earlier than what holds its parts."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, halves, bound = self.rank, self.halves, (float("inf"), 0)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and (rank[joined], 0) < bound:
                return False
            # Of equal merges the one further left is done first, so a merge on the
            # right at the same rank comes after the border's merge.
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                bound, left = (rank[left], 0), halves[left][1]
            else:
                bound, right = (rank[right], 1), halves[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word (its UTF-8 bytes, at least one)."""
        s = word[:-1].decode("latin-1") + chr(256 + word[-1])
        n, length, shorter = len(s), self.length, self.shorter
        longest = [-1] * n
        for last, token in self.automaton.iter(s):
            first = last + 1 - length[token]
            if longest[first] < 0 or length[token] > length[longest[first]]:
                longest[first] = token
        out: list[int] = []
        barred = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (barred[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"the vocabulary can't encode {word[:40]!r}")
                barred[at] = 1
                token = out.pop()
                at -= length[token]
        return out


class Encoder(dict):
    """Ids of texts as little-endian uint32 bytes; a bounded dict of chunks between spaces."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.vocab = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.vocab.special)) + ")")

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for w in self._split(chunk):
            ids += self.vocab.encode_word(w)
        out = array("I", ids).tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def _split(self, chunk: str) -> list[bytes]:
        """Words of normal text as bytes. Beyond Latin letters the library's own splitter is asked, whose
        Unicode tables may be of another version than Python's."""
        if max(chunk, default="") <= LATIN:
            return [w.encode() for w in self.words.findall(chunk)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif max(text) <= LATIN:
            text = unicodedata.normalize("NFC", text).lower()
        else:
            text = self.library.normalizer.normalize_str(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.vocab.special):
            return self._plain(text)
        return b"".join(array("I", [self.vocab.special[p]]).tobytes() if p in self.vocab.special else self._plain(p)
                        for p in self.cut.split(text))


class OffsetTable:
    """Texts of ids, one after the other with a separator, and where each begins."""

    def __init__(self, texts: list[bytes], separator: bytes = b" "):
        lengths = np.array([len(t) + len(separator) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.length = lengths
        self.blob = np.frombuffer(b"".join(t + separator for t in texts), np.uint8)
        self.separator = len(separator)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, each with its separator, and where each id's bytes end."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat((self.start[ids] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(at.size, dtype=np.int32)
        return self.blob[at], ends

    def join(self, ids: np.ndarray) -> bytes:
        data, _ = self.gather(ids)
        return data[:max(0, data.size - self.separator)].tobytes()


class Codec:
    def __init__(self, path: str):
        self.encoder = Encoder(path)
        strings = self.encoder.vocab.strings
        self.tokens = OffsetTable([s.encode() for s in strings])
        self.decimals = OffsetTable([b"%d" % i for i in range(len(strings))])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.join(ids).decode()


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    path = path or tokenizer_path("word_bpe_49k.json")
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _sha(data: np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) per document; ``decode`` is its inverse up to the tokenizer's normal form."""
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = [c.encode(t) for t in part.column("_text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [id_col, "ids"])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    return base.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) per row of (id, ids); null ids give an empty text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(f"`{id_col}`", "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per document, encoded and decoded in one map over the rows."""
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                raw = [c.encoder.encode(t) for t in part.column("_text").to_pylist()]
                counts = np.array([len(r) // 4 for r in raw], np.int64)
                ids = np.frombuffer(b"".join(raw), np.uint32)
                digests = []
                for table in (c.decimals, c.tokens):
                    data, ends = table.gather(ids)
                    last = np.concatenate([[0], ends])[np.cumsum(counts)]
                    first = np.concatenate([[0], last[:-1]])
                    digests.append([_sha(data[a:max(a, b - table.separator)]) for a, b in zip(first.tolist(), last.tolist())])
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(counts), *[pa.array(d, pa.string()) for d in digests]],
                                                 [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    return base.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
