"""Operator 3: packing documents into token windows by minimum bin slack.

Each document becomes its byte-level BPE ids plus an end id. Whole windows are
cut off its front; what remains is shorter than a window. The plan needs only how many
remainders have each length (at most ``window`` - 1 counts, whatever the size of
the corpus): the longest remainder opens a window, a subset-sum over a bitset
finds the multiset of the others that fills the rest best, and the pattern
is repeated as often as the counts allow. When the best filling leaves more than
``tolerance`` free, the gap is filled with the front of the longest other remainder, whose
rest goes back to the counts.

The counts are the only thing that reaches the driver. A remainder finds its window by
its number among those of its length: numbers inside a task are given
while tokenising, each task's offset is a running sum over (length, task)
counts, so a length shared by a third of all rows is no hot group.

Defined cases: null text counts as empty (one piece, the end id); repeated rows
are packed one by one; an empty table gives an empty result; texts of any length are cut into whole windows; a
special token's string inside a text has its special id, as the tokenizers library does; other columns are never
read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize, slices, text_of, tidy, tokenizer_path

WINDOW = 2048
END_ID = 1
TOLERANCE = 16
CACHE_CHUNKS = 100_000


class _Odd(Exception):
    """The text has white space that the chunk cache can't cut at."""


class ByteBpe(dict):
    """Byte-level BPE ids of texts as little-endian uint32 bytes.

    No token spans the border before a single space or line end, so the
    ids of a text are those of its chunks, kept in this dict (emptied when
    it has ``CACHE_CHUNKS`` entries). Texts with other white space or with
    special tokens are encoded whole."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import json

        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded when a text holds a special token."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.json_path)

    def __missing__(self, chunk: str) -> bytes:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if body.split() != [body]:
            raise _Odd
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        ids = self.plain.encode_ordinary(chunk if body is not chunk else " " + chunk)
        self[chunk] = out = array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.replace("\n", " \n").split(" ")
        if chunks[0].split() == [chunks[0]]:
            try:
                return array("I", self.plain.encode_ordinary(chunks[0])).tobytes() + b"".join(map(self.__getitem__, chunks[1:]))
            except _Odd:
                pass
        return array("I", self.plain.encode_ordinary(text)).tobytes()


_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def _encoder(json_path: str, ranks_path: str) -> ByteBpe:
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(*key)
    return _ENCODERS[key]


# ---- tokenising --------------------------------------------------------------

def token_pieces(docs: DataFrame, id_col: str, text_col: str, window: int, end_id: int,
                 json_path: str, ranks_path: str) -> DataFrame:
    """(_id, _key, _task, _nth, start, length, ids_crc32, doc_tokens): the whole
    windows of each document (numbered in their task) and its remainder
    (numbered in its task among those of its length)."""
    from pyspark import TaskContext

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _key long, _task int, _nth long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = _encoder(json_path, ranks_path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, which = [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    ids = memoryview(enc.encode(text) + end)
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        which.append(i)
                        rows.append((task, seen[length], start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n))
                        seen[length] += 1
                cols = list(zip(*rows))
                take = part.select(["_id", "_key"]).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*take.columns, pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                    ["_id", "_key", "_task", "_nth", "start", "length", "ids_crc32", "doc_tokens"])
        enc.clear()

    text = text_of(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text")).mapInArrow(tidy(run), schema)


# ---- the plan ----------------------------------------------------------------

def best_subset(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """The (length, copies) multiset within ``counts`` whose sum is the
    largest up to ``capacity``; ``counts`` in descending order of length."""
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length, n in counts:
        if length > capacity:
            continue
        copies = 1
        n = min(n, capacity // length)
        while n:                                   # copies in powers of two: any number of them can be made up
            take = min(copies, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            n -= take
            copies *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan_windows(histogram: dict[int, int], window: int = WINDOW, tolerance: int = TOLERANCE):
    """Windows for remainders given as length -> count.

    Returns (entries, windows). ``entries[(length, start)]`` is for the remainders of
    that length of which ``start`` ids are already placed: rows (lo, hi, first window,
    copies a window, index of lo, offset, piece length, number of lo among the rests).
    The last is -1 where the piece ends the remainder."""
    count = [0] * (window + 1)
    stock: list[deque] = [deque() for _ in range(window + 1)]     # per length: (kind, lo, hi) of its items
    made: dict[tuple[int, int], int] = {}
    entries: dict[tuple[int, int], list[tuple]] = {}

    def put(kind: tuple[int, int], lo: int, n: int) -> None:
        length = kind[0] - kind[1]
        count[length] += n
        stock[length].append((kind, lo, lo + n))

    def place(length: int, n: int, first: int, copies: int, offset: int, piece: int) -> None:
        index = 0
        count[length] -= n
        while n:
            kind, lo, hi = stock[length].popleft()
            take = min(n, hi - lo)
            if hi - lo > take:
                stock[length].appendleft((kind, lo + take, hi))
            rest = -1
            if piece < length:
                over = (kind[0], kind[1] + piece)
                rest = made.get(over, 0)
                made[over] = rest + take
                put(over, rest, take)
            entries.setdefault(kind, []).append((lo, lo + take, first, copies, index, offset, piece, rest))
            index += take
            n -= take

    for length, n in histogram.items():
        if n:
            put((length, 0), 0, n)
    windows, longest = 0, window
    while True:
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            return entries, windows
        count[longest] -= 1
        left = [(k, count[k]) for k in range(min(longest, window - longest), 0, -1) if count[k]]
        used = dict(best_subset(left, window - longest)) if left else {}
        count[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        gap = window - sum(k * c for k, c in used.items())
        times = min(count[k] // c for k, c in used.items())
        donor = 0
        if gap > tolerance:
            donor = next((k for k in range(longest, gap, -1) if count[k] > used.get(k, 0)), 0)
            if donor:
                uses = used | {donor: used.get(donor, 0) + 1}
                times = min(count[k] // c for k, c in uses.items())
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            place(length, times * copies, windows, copies, offset, length)
            offset += length * copies
        if donor:
            place(donor, times, windows, 1, offset, gap)
        windows += times


def _lookup(entries: dict[tuple[int, int], list[tuple]]):
    """Arrays per kind, ordered by lo."""
    return {kind: np.array(sorted(rows), np.int64) for kind, rows in entries.items()}


def locate(table: dict, length: int, number: int) -> list[tuple[int, int, int, int]]:
    """(start, piece length, window, offset) of the pieces of a remainder."""
    out, start = [], 0
    while True:
        rows = table[(length, start)]
        lo, _, first, copies, index, offset, piece, rest = rows[np.searchsorted(rows[:, 0], number, "right") - 1].tolist()
        j = index + number - lo
        out.append((start, piece, first + j // copies, offset + j % copies * piece))
        if rest < 0:
            return out
        start, number = start + piece, rest + number - lo


# ---- the operator ------------------------------------------------------------

def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tolerance: int = TOLERANCE, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Windows of the plan are numbered from 0; a whole
    window of one document has the number (task + 1) * 2**40 + its number in the task."""
    paths = json_path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    pieces = materialize(token_pieces(docs, id_col, text_col, window, end_id, *paths))
    rests = pieces.filter(F.col("length") < window)
    per_task = rests.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {int(r["length"]): int(r["n"]) for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries, _ = plan_windows(histogram, window, tolerance)
    cuts = any(row[-1] >= 0 for rows in entries.values() for row in rows)
    table = docs.sparkSession.sparkContext.broadcast(_lookup(entries))   # bounded by the window, not by the corpus

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (first, length, number, crc) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("start", "length", "_number", "ids_crc32")])):
                found = locate(table.value, length, number)
                for start, piece, seq, offset in found:
                    which.append(i)
                    rows.append((first + start, piece, crc if len(found) == 1 else None, seq, offset))
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                take = batch.select(["_id", "_key", "doc_tokens"]).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), *cols[:3], take.column(2), *cols[3:]],
                                                 ["_id", "_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = (rests.join(offsets, ["length", "_task"])
                   .select("_id", "_key", "start", "length", (F.col("_off") + F.col("_nth")).alias("_number"), "ids_crc32", "doc_tokens")
                   .mapInArrow(assign, schema))
    whole = pieces.filter(F.col("length") == window).select(
        "_id", "_key", "start", "length", "ids_crc32", "doc_tokens",
        ((F.col("_task").cast("long") + 1) * F.lit(1 << 40) + F.col("_nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = whole.unionByName(placed)
    if cuts:
        out = _with_cut_crcs(docs, out, id_col, text_col, end_id, paths)
    return out.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _with_cut_crcs(docs: DataFrame, out: DataFrame, id_col: str, text_col: str, end_id: int, paths: tuple[str, str]) -> DataFrame:
    """Fills ids_crc32 of the pieces that the plan cut: only documents with such a piece
    are tokenised again (found by a bitmap of fixed size, then an exact join)."""
    from .util import key_bitmap, mark_members

    out = materialize(out)
    cut = out.filter(F.col("ids_crc32").isNull())
    want = cut.select("_id", "_key", "start", "length").distinct()
    text = text_of(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    texts = mark_members(texts, key_bitmap(want, "_id", "_key"), "_id", "_key", name="_hit").filter("_hit").drop("_hit")
    texts = texts.dropDuplicates(["_id", "_key"])
    joined = texts.join(want.withColumnRenamed("_id", "_wid").withColumnRenamed("_key", "_wkey"),
                        F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_key") == F.col("_wkey"))) \
        .select("_id", "_key", "_text", "start", "length")
    kind = docs.schema[id_col].dataType.simpleString()

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, last, ids = _encoder(*paths), array("I", [end_id]).tobytes(), None, memoryview(b"")
        for batch in batches:
            for part in slices(batch, "_text"):
                got = []
                for text, start, length in zip(*[part.column(c).to_pylist() for c in ("_text", "start", "length")]):
                    if text != last:
                        last, ids = text, memoryview(enc.encode(text) + end)
                    got.append(zlib.crc32(ids[4 * start:4 * (start + length)]))
                yield pa.RecordBatch.from_arrays([*part.select(["_id", "_key", "start", "length"]).columns, pa.array(got, pa.int64())],
                                                 ["_id", "_key", "start", "length", "_crc"])

    crc = joined.mapInArrow(crcs, f"_id {kind}, _key long, start long, length long, _crc long")
    c, k = cut.alias("c"), crc.alias("k")
    filled = c.join(k, F.col("c._id").eqNullSafe(F.col("k._id")) & (F.col("c._key") == F.col("k._key"))
                    & (F.col("c.start") == F.col("k.start")) & (F.col("c.length") == F.col("k.length"))) \
        .select("c._id", "c._key", "c.start", "c.length", F.col("_crc").alias("ids_crc32"), "c.doc_tokens", "c.sequence_id", "c.offset")
    return out.filter(F.col("ids_crc32").isNotNull()).unionByName(filled)
