"""Every question of a tenant against every item of it, best ``k`` per question.

Such a search is quadratic by nature. Here its rows are dealt into cells (tenant, block of
items, block of questions) by hashes, so many that a cell holds a bounded number of rows of
either side whatever the tenant's size; a task scores one cell at a time with numpy and returns
k items per question. No pair is ever written, shuffled or spilled: what travels is each item
once per block of questions and each question once per block of items. An item travels as one row, also
one that holds many postings.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import release_memory
from .common import lookup

POSTINGS = 1 << 21        # of a cell
VECTORS = 1 << 15
QUESTIONS = 1 << 16
DENSE = 0.004             # share of pairs from which a term is multiplied as a matrix
DENSE_CELLS = 1 << 23     # of that matrix
CELL = ["tenant_id", "_d", "_c"]


def by_cell(items: DataFrame, item_key: str, questions: DataFrame, question_key: str, sizes: DataFrame,
            per_cell: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str, wide: int = 1,
            shared: DataFrame | None = None) -> DataFrame:
    """``score`` of each cell's items and questions. ``sizes`` counts both sides by
    tenant (tenant_id, n_items, n_questions); tenants that lack one are left out. A cell takes ``wide`` times
    QUESTIONS; the rows of ``shared`` go with the questions into every cell of their tenant."""
    blocks = lookup(sizes.select("tenant_id", F.greatest(F.ceil(F.col("n_items") / per_cell), F.lit(1)).cast("int").alias("_nd"),
                                 F.greatest(F.ceil(F.col("n_questions") / (QUESTIONS * wide)), F.lit(1)).cast("int").alias("_nc")))

    def each(name: str, count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)

    def dealt(rows: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        j = rows.join(blocks, "tenant_id").withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        return j.withColumn(other, each(other, n_other)).drop("_nd", "_nc")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return score(left, right)
        finally:
            release_memory()

    asked = dealt(questions, question_key, "_c", "_nc", "_d", "_nd")
    if shared is not None:
        everywhere = shared.join(blocks, "tenant_id").withColumn("_d", each("_d", "_nd")).withColumn("_c", each("_c", "_nc")).drop("_nd", "_nc")
        asked = asked.unionByName(everywhere, allowMissingColumns=True)
    return dealt(items, item_key, "_d", "_nd", "_c", "_nc").groupBy(*CELL).cogroup(asked.groupBy(*CELL)).applyInArrow(run, schema)


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as Spark's ``round``: half up on the shortest decimal form."""
    y = np.abs(x) * 10.0 ** places
    low = np.floor(y)
    out = np.copysign((low + (y - low >= 0.5)) / 10.0 ** places, x)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out + 0.0


def ordered_codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that sort as Spark sorts the values, nulls first."""
    enc = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    place = np.empty(len(enc.dictionary), np.int64)
    place[np.asarray(pc.array_sort_indices(enc.dictionary, null_placement="at_start"))] = np.arange(len(enc.dictionary))
    return place[np.asarray(enc.indices)]


def _table(left: pa.Table, item_rows: np.ndarray, keep: list[str], right: pa.Table, question_rows: np.ndarray,
           asked: list[str], score: pa.Array) -> pa.Table:
    """The columns ``asked`` of the questions, ``keep`` of the items, and the score."""
    q, i = pa.array(question_rows, pa.int64()), pa.array(item_rows, pa.int64())
    return pa.table([*[right.column(c).take(q) for c in asked], *[left.column(c).take(i) for c in keep], score], names=[*asked, *keep, "score"])


# Sums of term weights ------------------------------------------------------------
def _words(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts joined by one space, and how many each text has."""
    lists = pc.split_pattern(column.combine_chunks(), " ")
    return pc.list_flatten(lists), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def _codes(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.index_in(words, vocabulary), -1)).astype(np.int64)


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (lengths[0] numbers), then those from first[1] on, .."""
    return np.arange(int(lengths.sum())) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)


def best_sums(left: pa.Table, right: pa.Table, ids: list[str], k: int, k1: float = 1.2, b: float = 0.75, places: int = 6,
              batch: int = 1 << 22) -> pa.Table:
    """(tenant_id, _q, ids, score): per question the ``k`` first ids[0] by BM25, rounded; of several items
    (ids) with the same ids[0] the best stands, the first of equal ones. Rows that repeat an item add up.

    ``left`` holds items: ids, ``terms`` (joined by a space), their counts ``tfs`` and the length ``dl``. ``right`` holds
    questions (``_q``, ``_terms``) and, where ``_q`` is null, the tenant's vocabulary: ``_terms`` with their ``_df``, ``_n`` items in all
    of mean length ``_avgdl``. Scores in single precision find what may be among the k: a matrix product over the
    terms that many pairs share, and the postings of the others added one by one. What may enter is then
    scored in double precision, term after term."""
    none, asked = np.zeros(0, np.int64), ["tenant_id", "_q"]
    is_word = pc.is_null(right.column("_q"))
    known, right = right.filter(is_word), right.filter(pc.invert(is_word))
    if not left.num_rows or not right.num_rows or not known.num_rows:
        return _table(left, none, ids, right, none, asked, pa.array([], pa.float64()))
    vocabulary, _ = _words(known.column("_terms"))
    df, size = np.asarray(pc.list_flatten(known.column("_df").combine_chunks())).astype(float), len(vocabulary)
    idf = np.log(1.0 + (known.column("_n")[0].as_py() - df + 0.5) / (df + 0.5))

    # items ascend by ids; postings by term, then item
    key, group = np.zeros(left.num_rows, np.int64), ordered_codes(left.column(ids[0]))
    for c in ids:
        code = ordered_codes(left.column(c))
        key = np.unique(key * (int(code.max()) + 1) + code, return_inverse=True)[1]
    _, row = np.unique(key, return_index=True)
    n, group = row.size, group[row]
    words, held = _words(left.column("terms"))
    code, of_row = _codes(words, vocabulary), np.repeat(np.arange(left.num_rows), held)
    use = np.flatnonzero(code >= 0)
    code, of_row, tf = code[use], of_row[use], np.asarray(pc.list_flatten(left.column("tfs").combine_chunks()))[use].astype(float)
    length = b * np.asarray(left.column("dl")).astype(float) / known.column("_avgdl")[0].as_py()
    weight, pair = idf[code] * tf * (k1 + 1) / (tf + k1 * ((1 - b) + length[of_row])), code * n + key[of_row]
    del words, code, of_row, tf, use
    order = np.argsort(pair, kind="stable")
    pair, weight = pair[order], weight[order]
    new = np.diff(pair, prepend=-1) > 0
    if not new.all():
        pair, weight = pair[new], np.bincount(np.cumsum(new) - 1, weight)
    item, single, first = pair % n, weight.astype(np.float32), np.searchsorted(pair, np.arange(size + 1) * n)
    del order, new

    words, n_terms = _words(right.column("_terms"))
    q_code, q_row = _codes(words, vocabulary), np.repeat(np.arange(right.num_rows), n_terms)
    q_code, q_row = q_code[q_code >= 0], q_row[q_code >= 0]
    q_from = np.searchsorted(q_row, np.arange(right.num_rows + 1))
    del words

    shared = np.bincount(q_code, minlength=size) / right.num_rows * (np.diff(first) / n)
    common = np.argsort(-shared, kind="stable")[:min(int((shared > DENSE).sum()), DENSE_CELLS // n)]
    place = np.full(size, -1)
    place[common] = np.arange(common.size)
    exact = np.zeros((common.size, n))
    for h, t in enumerate(common.tolist()):
        exact[h, item[first[t]:first[t + 1]]] = weight[first[t]:first[t + 1]]
    dense = exact.astype(np.float32)

    # runs of whole ids[0]; the k-th best of their maxima is a bound for the k-th best ids[0]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    starts = starts[np.diff(starts // min(128, max(1, n // (16 * k))), prepend=-1) > 0]
    lengths = np.diff(starts, append=n)
    step = min(max(1, batch // n), 1 << 12, right.num_rows)
    sums = np.empty((step, n), np.float32)
    got_q, got_i, got_s = [], [], []
    for a in range(0, right.num_rows, step):
        e = min(a + step, right.num_rows)
        about, mine = sums[:e - a], slice(q_from[a], q_from[e])
        code, q = q_code[mine], q_row[mine] - a
        at = place[code]
        chosen = np.zeros((e - a, common.size), np.float32)
        chosen[q[at >= 0], at[at >= 0]] = 1
        np.matmul(chosen, dense, out=about)
        _add(about, q[at < 0], code[at < 0], first, item, single)

        top = np.maximum.reduceat(about, starts, axis=1)
        least = np.partition(top, starts.size - k, axis=1)[:, starts.size - k] if starts.size > k else np.zeros(e - a)
        terms = np.diff(q_from[a:e + 1])
        least = np.maximum(least - least * (terms + 4) * 1.2e-7 - 2 * 10.0 ** -places, 1e-30)
        q, g = np.nonzero(top >= least[:, None])
        q, near = np.repeat(q, lengths[g]), _runs(starts[g], lengths[g])
        fit = about[q, near] >= least[q]
        q, near = q[fit], near[fit]

        of = np.repeat(np.arange(q.size), terms[q])
        code, at = q_code[_runs(q_from[a + q], terms[q])], near[of]
        add, h = np.empty(of.size), place[code]
        add[h >= 0] = exact[h[h >= 0], at[h >= 0]]
        rare = np.flatnonzero(h < 0)
        want = code[rare] * n + at[rare]
        order = np.argsort(want)
        found = np.empty(rare.size, np.int64)
        found[order] = np.minimum(np.searchsorted(pair, want[order]), pair.size - 1)
        add[rare] = np.where(pair[found] == want, weight[found], 0.0)
        score = half_up(np.bincount(of, add, q.size), places)

        order = np.lexsort((near, -score, q))
        q, near, score = q[order], near[order], score[order]
        best = np.sort(np.unique(q * n + group[near], return_index=True)[1])
        q, near, score = q[best], near[best], score[best]
        fit = np.arange(q.size) - np.searchsorted(q, q) < k
        got_q.append(a + q[fit])
        got_i.append(row[near[fit]])
        got_s.append(score[fit])
    return _table(left, np.concatenate(got_i), ids, right, np.concatenate(got_q), asked, pa.array(np.concatenate(got_s), pa.float64()))


def _add(sums: np.ndarray, q: np.ndarray, code: np.ndarray, first: np.ndarray, item: np.ndarray, weight: np.ndarray, batch: int = 1 << 20) -> None:
    """Adds the postings of the terms ``code`` to the rows ``q`` of ``sums``, about ``batch`` of them at a time."""
    lengths, n = first[code + 1] - first[code], sums.shape[1]
    upto = np.cumsum(lengths)
    s = 0
    while s < code.size:
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + batch, "right")))
        at = _runs(first[code[s:e]], lengths[s:e])
        np.add.at(sums.reshape(-1), np.repeat(q[s:e] * n, lengths[s:e]) + item[at], weight[at])
        s = e


# Cosines -------------------------------------------------------------------------
def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of the rows that hold ``dim`` finite numbers."""
    col = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(col.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64)      # a null is NaN
    m = flat.reshape(rows.size, dim)
    fine = np.isfinite(m).all(1)
    return rows[fine], m[fine]


def _sum(x: np.ndarray) -> np.ndarray:
    """Row sums added from left to right, as the column expression adds."""
    return np.add.accumulate(x, axis=1)[:, -1]


def _odd_cosine(a: list | None, b: list | None, equal_len: bool, places: int) -> float | None:
    """The cosine of vectors that are not ``dim`` finite numbers, by the column expression's rules."""
    if a is None or b is None or (equal_len and len(a) != len(b)):
        return None
    n = min(len(a), len(b))
    if any(x is None for x in (*a[:n], *b[:n])):
        return None
    dot = lambda x, y: _sum(np.array([[0.0, *(np.array(x[:n], float) * np.array(y[:n], float))]]))[0]
    with np.errstate(all="ignore"):
        den = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
        x = dot(a, b) / (1.0 if den == 0 else den)
    return float(half_up(np.array([x]), places)[0]) if np.isfinite(x) else float(x) + 0.0


def best_cosines(left: pa.Table, right: pa.Table, id_col: str, keep: list[str], k: int, vec_col: str = "embedding",
                 equal_len: bool = False, places: int = 4, batch: int = 1 << 23) -> pa.Table:
    """(query_id, tenant_id, keep, score): per question the ``k`` first items by the rounded cosine of
    ``query_vec`` and ``vec_col``, then by id. One matrix product in single precision finds the items that may be among
    them; these are scored in double precision. Equal vectors are compared once. Vectors that are null, hold a
    null or a non-finite number, or have another length than the others are compared one by one."""
    asked, none = ["query_id", "tenant_id"], np.zeros(0, np.int64)
    if not left.num_rows or not right.num_rows:
        return _table(left, none, keep, right, none, asked, pa.array([], pa.float64()))
    lengths = pc.mode(pc.list_value_length(right.column("query_vec").combine_chunks()))
    dim = int(lengths[0]["mode"].as_py()) if len(lengths) else 0
    place = ordered_codes(left.column(id_col))
    rows, items = _matrix(left.column(vec_col), dim)
    asking, vecs = _matrix(right.column("query_vec"), dim)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    if rows.size and asking.size and dim:
        order = np.argsort(place[rows], kind="stable")
        rows, items = rows[order], items[order]
        item, of_item = _distinct(items)
        held = np.argsort(of_item, kind="stable")                   # rows of a vector, by id
        held_from = np.searchsorted(of_item[held], np.arange(len(item) + 1))
        ask, of_ask = _distinct(vecs)
        same = np.argsort(of_ask, kind="stable")
        same_from = np.searchsorted(of_ask[same], np.arange(len(ask) + 1))
        norm, ask_norm = np.sqrt(_sum(item * item)), np.sqrt(_sum(ask * ask))
        unit = (item / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32).T
        step = max(1, batch // len(item))
        for a in range(0, len(ask), step):
            part = ask[a:a + step]
            about = (part / np.where(ask_norm[a:a + step] == 0, 1, ask_norm[a:a + step])[:, None]).astype(np.float32) @ unit
            least = np.partition(about, len(item) - k, 1)[:, len(item) - k] if len(item) > k else np.full(len(part), -9.0, np.float32)
            q, i = np.nonzero(about >= (least - 1.2 * 10.0 ** -places)[:, None])
            del about
            score = np.empty(q.size)
            for s in range(0, q.size, 1 << 16):
                cut = slice(s, s + (1 << 16))
                den = ask_norm[a + q[cut]] * norm[i[cut]]
                score[cut] = _sum(part[q[cut]] * item[i[cut]]) / np.where(den == 0, 1, den)
            score = half_up(score, places)
            # each vector stands for its first k rows; then the first k rows of a question
            n = np.minimum(held_from[i + 1] - held_from[i], k)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, score, at = np.repeat(q, n), np.repeat(score, n), held[np.repeat(held_from[i], n) + nth]
            q, score, at = _first(q, score, place[rows[at]], at, k)
            n = same_from[a + q + 1] - same_from[a + q]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            got.append((asking[same[np.repeat(same_from[a + q], n) + nth]], rows[np.repeat(at, n)], np.repeat(score, n)))

    odd_items, odd_asked = np.setdiff1d(np.arange(left.num_rows), rows), np.setdiff1d(np.arange(right.num_rows), asking)
    pairs = [(q, i) for q in range(right.num_rows) for i in odd_items.tolist()] if odd_items.size else []
    pairs += [(q, i) for q in odd_asked.tolist() for i in rows.tolist()]
    score = np.concatenate([s for _, _, s in got]) if got else np.zeros(0)
    null = np.zeros(score.size, bool)
    if pairs:
        v, w = left.column(vec_col), right.column("query_vec")
        more = [_odd_cosine(w[q].as_py(), v[i].as_py(), equal_len, places) for q, i in pairs]
        got.append((np.array([q for q, _ in pairs]), np.array([i for _, i in pairs]), np.zeros(len(pairs))))
        null = np.concatenate([null, [x is None for x in more]])
        score = np.concatenate([score, [0.0 if x is None else x for x in more]])
    if not got:
        return _table(left, none, keep, right, none, asked, pa.array([], pa.float64()))
    q, i = np.concatenate([x for x, _, _ in got]), np.concatenate([x for _, x, _ in got])
    return _table(left, i, keep, right, q, asked, pa.array(score, pa.float64(), mask=null))


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row's)."""
    m = np.ascontiguousarray(m + 0.0)                               # one zero
    _, first, number = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return m[first], number


def _first(q: np.ndarray, score: np.ndarray, place: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each question by score, then place."""
    order = np.lexsort((place, -score, q))
    q, score, at = q[order], score[order], at[order]
    nth = np.arange(q.size) - np.searchsorted(q, q)
    return q[nth < k], score[nth < k], at[nth < k]
