"""Operator 2: near-duplicate documents by ProbMinHash, banding and verification.

A document is the weighted set of its word shingles (five words; weight 1 + ln(count), so a
line repeated over and over doesn't outweigh the rest). Two documents are linked if the
probability Jaccard similarity of their sets,

    J_P(a, b) = sum_i 1 / sum_j max(a_j / a_i, b_j / b_i),

is at least 0.8; for sets without repeats this is the Jaccard similarity, taken as the exact quotient common / union. Groups are the connected components of the links.

1. Documents with the same words are one class (a hash of the words); only one of them goes on.
2. ProbMinHash: every shingle has a Poisson process whose rate is its weight; each arrival falls on
   one of ``REGISTERS`` registers, which keeps the first. A shingle stops as soon as its next arrival is later than the
   latest register. Two documents agree in a register with probability J_P.
3. Registers are banded. In a band's bucket every member is tied to one pivot, not to all members, so a bucket
   of any size gives as many pairs as members. The pivot is the member that shares the most buckets with others, such as
   the original of many copies. At 0.8 a pair shares no bucket with probability 6e-7.
4. Pairs are verified on the exact shingle sets, read again from the texts of documents in a pair only.
5. Buckets whose members aren't all in one component are looked at again, until every pair that shares a bucket is
   either compared or joined through others: a round with other pivots; then, in buckets of at most ``SMALL_BUCKET`` members, the
   pairs in different components (so at most ``SMALL_BUCKET`` / 2 per member and band); and in larger buckets all pairs in different components
   by blocks of documents, inside tasks that hand on links only, at most one per document.

Defined cases: a text that is null or has no word is in no shingle set and links with nothing; a text of fewer than five
words is one shingle of all its words; rows that repeat an id are one document (its classes are joined if its
texts differ); a row without an id is kept and not compared; an empty table gives an empty result; other columns are never read; texts are
read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import key_bitmap, mark_members, materialize, slices, text_of, tidy

SHINGLE = 5
SIMILARITY = 0.8
SLACK = 1e-9             # rounding of a sum of weights; sets without repeats are compared by an exact quotient
BANDS, BAND_ROWS = 36, 5
REGISTERS = BANDS * BAND_ROWS
SMALL_BUCKET = 16
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
CACHE_WORDS = 60_000
WORDS = re.compile(r"\w+")

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


def word_list(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def shingles(words: list[str], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, counts)."""
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    size = min(SHINGLE, len(w))
    out = np.zeros(len(w) - size + 1, _U)
    for k in range(size):
        out += _mix(w[k:k + out.size] + _U(k)) * _ODD[k]
    return np.unique(_mix(out + _U(size)), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of each (hashes, counts): the hash that holds each register. Sets mustn't be empty."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    h = np.concatenate([h for h, _ in sets])
    rate = weights(np.concatenate([c for _, c in sets]))
    first, held = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, _U)
    by_doc, last = first.reshape(len(sets), registers), np.full(len(sets), np.inf)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        r = _mix(h + _U(2 * turn * _STEP % 2 ** 64))
        time += -np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0 ** -53) / rate
        at = doc * registers + ((_mix(h + _U((2 * turn + 1) * _STEP % 2 ** 64)) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        held[at[won]] = h[won]
        open_docs = np.unique(doc) if turn > 8 else slice(None)
        last[open_docs] = by_doc[open_docs].max(1)
        go = time < last[doc]
        if not go.all():
            doc, h, rate, time = doc[go], h[go], rate[go], time[go]
    return held.reshape(len(sets), registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    rows = signature.reshape(len(signature), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=_U), rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        out = _mix(out + rows[:, :, k] * _ODD[k])
    return out.view(np.int64)


def flat(c1: np.ndarray, c2: np.ndarray) -> bool:
    """No shingle of either set is repeated."""
    return bool((c1 == 1).all() and (c2 == 1).all())


def similarity(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets given as (sorted hashes, counts)."""
    if not len(h1) or not len(h2):
        return 0.0
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if flat(c1, c2):
        return len(i) / (len(h1) + len(h2) - len(i))
    a, b = weights(c1), weights(c2)
    a_both, b_both = a[i], b[j]
    order = np.argsort(-(a_both / b_both), kind="stable")
    a_both, b_both = a_both[order], b_both[order]
    # For i, shingles with a larger ratio a/b than i's count by a, the others by b.
    a_up = a.sum() - a_both.sum() + np.cumsum(a_both)
    b_down = b.sum() - np.cumsum(b_both)
    return float((1 / (a_up / a_both + b_down / b_both)).sum())


def linked(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray, threshold: float) -> bool:
    """The similarity is ``threshold`` or more."""
    return similarity(h1, c1, h2, c2) >= (threshold if flat(c1, c2) else threshold - SLACK)


def block_links(one: dict, two: dict, threshold: float) -> np.ndarray:
    """Links (rows of two ids) between the documents of two blocks that are in different components, as
    a forest. A block: ids, roots, ends (of each set), h, c; the same object twice for the pairs inside it.

    The overlap of the weight shares, sum_i min(a_i / A, b_i / B), is an upper bound of J_P; it is summed for one document
    against a whole block at a time, and only pairs that it doesn't rule out are computed."""
    same = one is two
    _, codes = np.unique(np.concatenate([one["h"], two["h"]]), return_inverse=True)
    mark = np.zeros(codes.max(initial=0) + 1)
    first, second = codes[:len(one["h"])], codes[len(one["h"]):]
    w1, w2 = weights(one["c"]), weights(two["c"])
    start1, start2 = (np.concatenate([[0], b["ends"][:-1]]) for b in (one, two))
    size2, total2 = two["ends"] - start2, np.add.reduceat(w2, start2)
    flat2 = total2 == size2
    root = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i in range(len(one["ids"])):
        at = slice(start1[i], one["ends"][i])
        mark[first[at]] = w1[at]
        met = mark[second]
        mark[first[at]] = 0
        by_a = np.add.reduceat(met, start2)
        by_b = np.add.reduceat(np.where(met > 0, w2, 0.0), start2)
        n, total = at.stop - at.start, w1[at].sum()
        value = np.minimum(by_a / total, by_b / total2)
        exact = flat2 & (total == n)                      # no repeats: by_a counts the common shingles
        value[exact] = by_a[exact] / (n + size2[exact] - by_a[exact])
        may = (value >= np.where(exact, threshold, threshold - SLACK)) & (two["roots"] != one["roots"][i])
        if same:
            may[:i + 1] = False
        for j in np.flatnonzero(may):
            a, b = find(int(one["roots"][i])), find(int(two["roots"][j]))
            if a == b:
                continue
            to = slice(start2[j], two["ends"][j])
            if exact[j] or linked(one["h"][at], one["c"][at], two["h"][to], two["c"][to], threshold):
                root[max(a, b)] = min(a, b)
                out.append((int(one["ids"][i]), int(two["ids"][j])))
    return np.array(out, np.int64).reshape(-1, 2)


# ---- Spark steps -----------------------------------------------------------------

def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _class, _bands): the class hash of each document's words and its band keys (null without a word)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                classes, sets, at = [], [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    words = word_list(text)
                    classes.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None)
                    if words:
                        sets.append(shingles(words, hashes))
                        at.append(i)
                bands: list = [None] * part.num_rows
                if sets:
                    for i, keys in zip(at, band_keys(signatures(sets))):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "_class", "_bands"])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text")).filter("_id is not null")
    return base.mapInArrow(tidy(run), f"_id {kind}, _class binary, _bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _c): the exact shingle sets of the documents ``wanted`` (ids); no other text is split or shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                sets = [shingles(word_list(t), hashes) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([h.tobytes() for h, _ in sets], pa.binary()),
                                                  pa.array([b"" if (c == 1).all() else c.astype(np.uint32).tobytes() for _, c in sets], pa.binary())], ["_id", "_h", "_c"])

    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text")).filter("_id is not null")
    some = mark_members(base, key_bitmap(wanted, "_id"), "_id", name="_hit").filter("_hit").drop("_hit")
    return some.mapInArrow(tidy(run), f"_id {kind}, _h binary, _c binary").join(wanted, "_id", "left_semi").dropDuplicates(["_id"])


def _verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least ``threshold``."""
    ids = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    sets = materialize(_sets(docs, ids, id_col, text_col))
    kind = pairs.schema["a"].dataType.simpleString()

    def unpack(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(h, _U)
        return h, np.frombuffer(c, np.uint32) if c else np.ones(len(h), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(*unpack(*x[:2]), *unpack(*x[2:]), threshold)
                  for x in zip(*[(v.as_py() for v in batch.column(c)) for c in ("_h", "_c", "_h2", "_c2")])]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("_id").alias("a"), "_h", "_c")
    two = sets.select(F.col("_id").alias("b"), F.col("_h").alias("_h2"), F.col("_c").alias("_c2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_h", "_c", "_h2", "_c2").mapInArrow(tidy(run), f"a {kind}, b {kind}")


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, rep, root) of the buckets whose members are in more than one component of the links."""
    roots = components(links).select(F.col("node").alias("rep"), "component")
    with_root = members.join(roots, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("root"))
    mixed = with_root.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("key")
    return materialize(with_root.join(mixed, "key", "left_semi"))


def _pivot_pairs(mixed: DataFrame, order) -> DataFrame:
    """Every member tied to its bucket's pivot (the largest by ``order``) if they are in different components."""
    pivots = mixed.groupBy("key").agg(F.max_by(F.struct("rep", "root"), order).alias("_p"))
    return (mixed.join(pivots, "key").filter(F.col("root") != F.col("_p.root"))
                 .select(F.greatest("rep", "_p.rep").alias("a"), F.least("rep", "_p.rep").alias("b")).distinct())


def _pack_blocks(sets: DataFrame) -> DataFrame:
    """(grp, block, ids, roots, ends, h, c): runs of documents of a group, of at most ``BLOCK_DOCS`` rows and about ``BLOCK_BYTES``."""
    ranged = sets.repartitionByRange("grp", "root", "rep").sortWithinPartitions("grp", "root", "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(grp, rows):
            h = np.concatenate([np.frombuffer(x[2], _U) for x in rows])
            c = np.concatenate([np.frombuffer(x[3], np.uint32) if x[3] else np.ones(len(x[2]) // 8, np.uint32) for x in rows])
            ends = np.cumsum([len(x[2]) // 8 for x in rows]).astype(np.int64)
            ids, roots = (np.array([x[k] for x in rows], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([rows[0][0]], pa.int64()),
                                               *[pa.array([x.tobytes()], pa.binary()) for x in (ids, roots, ends, h, c)]],
                                              ["grp", "block", "ids", "roots", "ends", "h", "c"])

        key, rows, size = None, [], 0
        for batch in batches:
            for grp, rep, root, h, c in zip(*[(v.as_py() for v in batch.column(n)) for n in ("grp", "rep", "root", "_h", "_c")]):
                if rows and (grp != key or len(rows) >= BLOCK_DOCS or size + len(h) > BLOCK_BYTES):
                    yield flush(key, rows)
                    rows, size = [], 0
                key = grp
                rows.append((rep, root, h, c))
                size += len(h)
        if rows:
            yield flush(key, rows)

    return ranged.mapInArrow(cut, "grp long, block long, ids binary, roots binary, ends binary, h binary, c binary")


def _block_links(large: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Links between members of large buckets that are in different components. Buckets that share members form a
    group; a group's documents are cut into blocks, and pairs of blocks are compared inside tasks."""
    lead = large.groupBy("key").agg(F.min("rep").alias("b"))
    groups = components(large.join(lead, "key").select(F.col("rep").alias("a"), "b")).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    members = large.select("rep", "root").distinct().join(groups, "rep")
    sets = _sets(docs, members.select(F.col("rep").alias("_id")), id_col, text_col).withColumnRenamed("_id", "rep")
    blocks = materialize(_pack_blocks(members.join(sets, "rep").select("grp", "rep", "root", "_h", "_c")))
    fields = ["ids", "roots", "ends", "h", "c"]
    heads = blocks.select("grp", "block")
    pairs = heads.join(heads.select("grp", F.col("block").alias("block2")), "grp").filter("block <= block2")
    second = blocks.select("grp", F.col("block").alias("block2"), *[F.col(f).alias(f + "2") for f in fields])
    both = pairs.join(blocks, ["grp", "block"]).join(second, ["grp", "block2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int64, _U, np.uint32)
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name: batch.column(name)[row].as_py()
                one = {f: np.frombuffer(at(f), k) for f, k in zip(fields, kinds)}
                two = one if at("block") == at("block2") else {f: np.frombuffer(at(f + "2"), k) for f, k in zip(fields, kinds)}
                found = block_links(one, two, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per id: ``id_col``, class_id (smallest id of its group), group_size, kept (it is the class_id). Ids are integers."""
    docs = docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
    hashed = materialize(_hashed(docs, id_col, text_col))
    # Documents with the same words are one class, led by its smallest id.
    reps = materialize(hashed.filter(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("_id").alias("rep"), F.first("_bands").alias("_bands")))
    keyed = reps.select("rep", F.explode("_bands").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = materialize(mark_members(keyed, key_bitmap(shared, "key"), "key", name="_hit").filter("_hit").drop("_hit")
                          .join(shared, "key").select("key", "rep", "size"))
    # Ids whose rows differ in their words belong to several classes; they tie them.
    twice = hashed.filter(F.col("_class").isNotNull()).join(reps.select("_class", "rep"), "_class")
    tied = twice.groupBy("_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a <> b").select("a", "b")

    # Round 1: the pivot is the member with the most company over all its buckets.
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    known = members.join(company, "rep").select("key", "rep", F.col("rep").alias("root"), "company")
    pairs = materialize(_pivot_pairs(known, F.struct("company", "rep")))
    tried = pairs
    links = materialize(tied.unionByName(_verify(pairs, docs, id_col, text_col, threshold)))
    mixed = _with_roots(members.select("key", "rep"), links)
    # Round 2: any other pivot.
    if not mixed.isEmpty():
        pairs = materialize(_pivot_pairs(mixed, F.struct(F.xxhash64("rep"), "rep")).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        links = materialize(links.unionByName(_verify(pairs, docs, id_col, text_col, threshold)))
        mixed = _with_roots(mixed.select("key", "rep"), links)
    # What is left: members of a bucket in different components that no round compared.
    if not mixed.isEmpty():
        sized = materialize(mixed.join(mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"))
        small, large = sized.filter(F.col("n") <= SMALL_BUCKET), sized.filter(F.col("n") > SMALL_BUCKET)
        other = small.select("key", F.col("rep").alias("b"), F.col("root").alias("_root"))
        rest = small.join(other, "key").filter((F.col("rep") > F.col("b")) & (F.col("root") != F.col("_root"))).select(F.col("rep").alias("a"), "b")
        rest = materialize(rest.distinct().join(tried, ["a", "b"], "left_anti"))
        links = links.unionByName(_verify(rest, docs, id_col, text_col, threshold))
        if not large.isEmpty():
            links = links.unionByName(_block_links(large.select("key", "rep", "root"), docs, id_col, text_col, threshold))

    roots = components(links).select(F.col("node").alias("rep"), "component")
    named = hashed.join(reps.select("_class", "rep"), "_class", "left").join(roots, "rep", "left") \
        .groupBy("_id").agg(F.min(F.coalesce("component", "rep", "_id")).alias("class_id"))
    named = materialize(named)
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes, "class_id").select(F.col("_id").alias(id_col), "class_id", "group_size", (F.col("_id") == F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group, all columns as they were. Only rows whose id is
    dropped or repeated are shuffled (and the few that share a bitmap slot with one)."""
    cols = docs.columns
    groups = materialize(near_dedup(docs, id_col, text_col, threshold))
    gone = groups.filter(~F.col("kept")).select(F.col(id_col).alias("_id"))
    ids = docs.select(F.col(f"`{id_col}`").alias("_id"))
    twice = ids.filter("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                         F.xxhash64(*[F.col(f"`{c}`") for c in cols]).alias("_tie"))
    marked = mark_members(packed, key_bitmap(gone.unionByName(twice), "_id"), "_id", name="_hit").withColumn("_hit", F.col("_hit") & F.col("_id").isNotNull())
    tested = marked.filter("_hit").join(gone, "_id", "left_anti").groupBy("_id").agg(F.max_by("_row", "_tie").alias("_row")).select("_row")
    return marked.filter(~F.col("_hit")).select("_row").unionByName(tested).select("_row.*")
