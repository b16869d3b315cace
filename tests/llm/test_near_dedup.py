import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup as N


def weighted(text):
    """Shingle -> weight, by strings."""
    w = N.word_list(text or "")
    size = min(N.SHINGLE, len(w))
    grams = [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if w else []
    return {g: 1 + np.log(grams.count(g)) for g in set(grams)}


def prob_jaccard(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)


def brute_groups(rows, threshold=0.8):
    """Components over all pairs; ``similarity`` is held to its definition by a test of its own."""
    hashes = N.WordHash()
    sets = [N.shingles(N.word_list(t or ""), hashes) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or N.similarity(*sets[i], *sets[j]) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def prose(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


WORDS = ["".join(p) for p in __import__("itertools").product("bdgk", "aeo", "lmnr", "iu")]


def edited(rnd, words, times):
    out = list(words)
    for _ in range(times):
        out[rnd.randrange(len(out))] = "x%d" % rnd.randrange(10 ** 6)
    return out


def test_similarity_by_definition():
    rnd = random.Random(1)
    for _ in range(30):
        a = prose(rnd, 60)
        b = edited(rnd, a, rnd.randint(0, 6)) + a[:20] * rnd.randint(0, 3)
        x, y = " ".join(a), " ".join(b)
        got = N.similarity(*N.shingles(N.word_list(x), N.WordHash()), *N.shingles(N.word_list(y), N.WordHash()))
        assert abs(got - prob_jaccard(weighted(x), weighted(y))) < 1e-9


def test_registers_estimate_the_similarity():
    rnd, error = random.Random(2), []
    for _ in range(40):
        a = prose(rnd, 80)
        b = edited(rnd, a, rnd.randint(1, 8)) + a[:25] * rnd.randint(0, 2)
        sets = [N.shingles(x, N.WordHash()) for x in (a, b)]
        s = N.signatures(sets, 4096)
        error.append((s[0] == s[1]).mean() - N.similarity(*sets[0], *sets[1]))
    assert abs(np.mean(error)) < 0.01 and np.abs(error).max() < 0.04


def test_signature_does_not_depend_on_the_company():
    rnd = random.Random(3)
    sets = [N.shingles(prose(rnd, n), N.WordHash()) for n in (1, 7, 400, 3000, 5)]
    whole = N.signatures(sets)
    assert all((N.signatures([s])[0] == whole[i]).all() for i, s in enumerate(sets))


def test_block_links_join_as_all_pairs_do():
    rnd = random.Random(11)
    base = prose(rnd, 60)
    texts = [" ".join(edited(rnd, base, rnd.randint(0, 3)) + base[:8] * (i % 3 == 0) * 2) for i in range(40)]
    sets = [N.shingles(N.word_list(t), N.WordHash()) for t in texts]

    def block(at):
        return {"ids": np.array(at), "roots": np.array(at), "ends": np.cumsum([len(sets[i][0]) for i in at]),
                "h": np.concatenate([sets[i][0] for i in at]), "c": np.concatenate([sets[i][1] for i in at]).astype(np.uint32)}

    x, y = block(list(range(0, 25))), block(list(range(25, 40)))
    got = np.concatenate([N.block_links(x, x, 0.8), N.block_links(x, y, 0.8), N.block_links(y, y, 0.8)])
    assert all(N.similarity(*sets[a], *sets[b]) >= 0.8 for a, b in got)
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in got:
        root[find(a)] = find(b)
    want = brute_groups(list(enumerate(texts)))
    assert {frozenset(i for i in range(40) if find(i) == r) for r in set(map(find, range(40)))} == \
        {frozenset(i for i in range(40) if want[i] == r) for r in set(want.values())}
    assert 2 < len(set(want.values())) < 40


def pair_at(union):
    """Two flat sets of shingles that share exactly four fifths of ``union``."""
    common, h = union * 4 // 5, np.arange(union, dtype=np.uint64)
    left = (union - common) // 2
    return h[:common + left], np.concatenate([h[:common], h[common + left:]])


def test_pairs_at_exactly_the_threshold_are_linked():
    for union in range(5, 5001, 5):
        a, b = pair_at(union)
        one, two = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        assert N.similarity(a, one, b, two) == 0.8 and N.linked(a, one, b, two, 0.8), union
        assert not N.linked(a[1:], one[1:], b, two, 0.8), union


def test_weighted_pairs_at_exactly_the_threshold_are_linked_on_both_paths():
    for union in range(5, 1001, 5):
        a, b = pair_at(union)
        one, two = np.full(len(a), 3), np.full(len(b), 3)             # every shingle as often: the weights cancel out
        assert N.linked(a, one, b, two, 0.8), union
        block = [{"ids": np.array([i]), "roots": np.array([i]), "ends": np.array([len(h)]), "h": h, "c": c.astype(np.uint32)} for i, h, c in ((0, a, one), (1, b, two))]
        assert len(N.block_links(*block, 0.8)) == 1, union


def test_a_text_with_two_words_changed_far_apart(spark):
    words = ["w%d" % i for i in range(94)]
    other = [w if i not in (20, 60) else "x%d" % i for i, w in enumerate(words)]          # 80 of 100 shingles
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert groups(df) == {1: 1, 2: 1}


def groups(df, **kw):
    return {r.doc_id: r.class_id for r in N.near_dedup(df, **kw).collect()}


def test_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert groups(docs) == brute_groups(rows)


@pytest.mark.parametrize("small", [16, 2])
def test_large_group_chains_and_shared_passages(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL_BUCKET", small)
    monkeypatch.setattr(N, "BLOCK_DOCS", 20)
    rnd = random.Random(7)
    base, passage, rows = prose(rnd, 120), prose(rnd, 60), []
    for i in range(90):
        rows.append((i, " ".join(edited(rnd, base, rnd.randint(1, 4)))))            # copies near the threshold to each other
    for i in range(100, 130):
        rows.append((i, " ".join(prose(rnd, 40) + passage + prose(rnd, 40))))       # a shared passage is no copy
    chain = prose(rnd, 200)
    for i in range(200, 212):
        chain = edited(rnd, chain, 2)
        rows.append((i, " ".join(chain)))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert groups(df) == want and len(set(want.values())) > 31


def test_nulls_short_empty_repeats_clashes_and_dropping(spark):
    long = " ".join(prose(random.Random(9), 30_000))
    rows = [(1, None, 0, b"z"), (2, "", 0, b"z"), (3, "!!", 0, b"z"), (4, "One two", 0, b"z"), (5, "one, TWO.", 0, b"z"), (6, "one two three", 0, b"z"),
            (7, long, 0, b"z"), (8, long + " end", 0, b"z"), (8, long + " end", 0, b"z"), (None, "one two", 0, b"z"), (9, "p q r s t u", 0, b"z"), (9, "a b c d e f", 0, b"z"),
            (11, "a b c d e f", 0, b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, _class binary")
    assert groups(df) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 11: 9}
    out = N.drop_near_copies(df)
    assert out.columns == df.columns and sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 1, 2, 3, 4, 6, 7, 9]
    assert N.near_dedup(df.limit(0)).count() == 0 and N.drop_near_copies(df.limit(0)).count() == 0
    assert N.near_dedup(df.filter(F.col("doc_id") < 4)).count() == 3
