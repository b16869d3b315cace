from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_score as M

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return M.train(docs)


def brute_windows(text, table):
    seq = [M.BORDER] * 2 + [int(table[min(ord(c), M.POINTS - 1)]) for c in text.lower()] + [M.BORDER] * 2
    return [(seq[i - 2], seq[i - 1], seq[i + 1], seq[i + 2], seq[i]) for i in range(2, len(seq) - 2)]


def code(w):
    out = 0
    for x in w:
        out = out * 32 + x
    return out


def test_windows_by_hand():
    table = M.class_table(list("etaoin"))
    texts = ["", "The cat\n9", "", "ab", "x"]
    got, counts = M.windows(texts, table)
    assert counts.tolist() == [0, 9, 0, 2, 1]
    assert got.tolist() == [code(w) for t in texts for w in brute_windows(t, table)]


def test_counts_and_alphabet_cover_all_documents(docs):
    texts = [r.text or "" for r in docs.select("text").collect()]
    letters = Counter(c for t in texts for c in t.lower() if c.isalpha() or not (c.isspace() or c.isdigit()))
    chars = M.alphabet(docs)
    assert chars == [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:M.CLASSES - M.FIRST_CHAR]]
    table = M.class_table(chars)
    want = Counter(code(w) for t in texts for w in brute_windows(t, table))
    assert {r.code: r.n for r in M.window_counts(docs, chars).collect()} == dict(want)


def test_scores_are_sums_of_both_sided_predictions(docs, net):
    table = M.class_table(net.chars)
    some = docs.orderBy(F.length("text")).limit(12)
    for r in M.score(some, net).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = 0.0
        for w in brute_windows(r.text, table):
            want += float(net.forward(np.array([code(w[:4])]))[2][0, w[4]])
        assert r.n_tokens == len(r.text) and abs(r.pll - want) < 1e-3 * max(1, abs(want))
        assert abs(r.mean_pll * max(1, r.n_tokens) - r.pll) < 1e-6


def test_probabilities_and_gradient():
    net = M.WindowNetwork.start(list("ab"), seed=3)
    net.w2 += np.random.default_rng(0).normal(0, 0.1, net.w2.shape).astype(np.float32)
    assert np.allclose(np.exp(net.forward(np.arange(50))[2]).sum(1), 1, atol=1e-5)
    codes, n = np.array([5 * 32 + 7, 9 * 32 + 1]), np.array([3, 1])
    before = net.forward(codes // 32)[2][[0, 1], codes % 32]
    net.train(codes, n, 60, 64, 0.05, 1)
    after = net.forward(codes // 32)[2][[0, 1], codes % 32]
    assert (after > before).all() and after[0] > -0.1


def test_prose_scores_above_shuffled_prose(spark, docs, net):
    rnd = np.random.default_rng(1)
    texts = [r.text for r in docs.filter(F.length("text") > 500).limit(30).collect()]
    mixed = ["".join(rnd.permutation(list(t))) for t in texts]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(texts + mixed)], "doc_id long, text string")
    got = {r.doc_id: r.mean_pll for r in M.score(both, net).collect()}
    assert all(got[i] > got[i + len(texts)] + 0.3 for i in range(len(texts)))
    assert np.mean([got[i] for i in range(len(texts))]) > -2.3        # a uniform guess has -3.47


def test_nulls_empty_clashes_and_empty_table(spark, net):
    d = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "the of " * 30_000, 3)], "doc_id long, text string, pll int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.pll == 0) for r in M.score(d, net).collect())
    assert got == [(0, 210_000, False), (1, 0, True), (2, 0, True), (2, 0, True)]
    empty = M.lm_score(d.filter("doc_id is not null"))
    assert {r.pll for r in empty.collect()} == {0.0} and M.lm_score(d.limit(0)).count() == 0


def test_every_window_is_trained_on_with_its_weight():
    seen = Counter()
    net = M.WindowNetwork.start(list("ab"))
    forward = net.forward
    net.forward = lambda context: seen.update(context.tolist()) or forward(context)
    codes = np.arange(0, 5000 * 32, 32, dtype=np.int64)
    counts = np.where(np.arange(5000) == 7, 10 ** 7, 1)
    net.train(codes, counts, 20, 64, 0.01, 1)
    assert set(seen) == set((codes // 32).tolist()) and seen[int(codes[7] // 32)] >= 1200     # all of them, the frequent one in parts


def test_the_network_does_not_depend_on_partitions(docs):
    a, b = M.train(docs.repartition(3), rounds=2, steps=20), M.train(docs.repartition(29), rounds=2, steps=20)
    assert a.chars == b.chars and all(np.allclose(x, y, atol=1e-6) for x, y in zip(a.params(), b.params()))


def test_a_minority_script_has_many_classes_and_garbled_text_scores_lower(spark, docs):
    words = "και να το του της με για από στην που είναι θα δεν μια ένα αυτό όταν πριν κάτι νερό σπίτι δρόμος φως".split()
    rnd = np.random.default_rng(2)
    greek = [" ".join(rnd.choice(words, 120)) for _ in range(60)]
    corpus = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in greek[:40]], "text string"))
    net = M.train(corpus)
    table = M.class_table(net.chars)
    assert len({int(table[ord(c)]) for c in "αβγδεζηθικλμνξοπρστυφχψω"}) >= 8
    mixed = ["".join(rnd.permutation(list(t))) for t in greek[40:]]
    both = spark.createDataFrame(list(enumerate(greek[40:] + mixed)), "doc_id long, text string")
    got = {r.doc_id: r.mean_pll for r in M.score(both, net).collect()}
    assert all(got[i] > got[i + 20] + 0.2 for i in range(20))
