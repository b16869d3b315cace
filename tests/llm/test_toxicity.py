import random

import numpy as np
from tessera.llm import toxicity as T

TABLES = "/root/testdata/sf0.1"


def test_margin_by_all_pairs():
    rnd = np.random.default_rng(1)
    m = T.ToxicityModel(np.arange(9), 0.3, rnd.normal(size=9), rnd.normal(size=(9, 4)))
    rows = np.array([0, 3, 4, 8])
    want = m.w0 + sum(m.w[i] for i in rows) + sum(m.v[i] @ m.v[j] for a, i in enumerate(rows) for j in rows[a + 1:])
    assert abs(m.margin(rows) - want) < 1e-9


def test_pairs_that_no_sum_of_weights_can_tell():
    rnd, texts, y = random.Random(2), [], []
    for _ in range(800):
        insult, other = rnd.choice(["foul", "vile"]), rnd.choice(["folk", "code"])
        texts.append(T.text_terms(f"{insult} {other} " + " ".join(rnd.choices("qa wb ec rd".split(), k=3))))
        y.append(int((insult == "foul") == (other == "folk")))     # toxic by the pair only
    y = np.array(y, float)
    assert not T.single_terms(texts, y).size                       # no term says anything alone
    m = T.fit(texts, y)                                            # production settings
    rows = T.TermRows(m.terms)
    score = {t: m.score(rows.of(t)) for t in ("foul folk qa", "vile code qa", "foul code qa", "vile folk qa")}
    assert score["foul folk qa"] > 0.9 and score["vile code qa"] > 0.9 and score["foul code qa"] < 0.1 and score["vile folk qa"] < 0.1


def test_a_rare_insult_with_production_settings():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts, y = [], []
    for i in range(3000):
        t = " ".join(rnd.choices(vocab, k=60))
        if i % 2:
            t += " zorgulon" if i < 40 else " " + rnd.choice(["idiot", "moron", "scum"])      # 20 texts hold the rare one only
        texts.append(T.text_terms(t))
        y.append(i % 2)
    m = T.fit(texts, np.array(y, float))
    rows = T.TermRows(m.terms)
    clean = [" ".join(rnd.choices(vocab, k=60)) for _ in range(50)]
    assert max(m.score(rows.of(t)) for t in clean) < 0.1
    assert min(m.score(rows.of(f"{t} zorgulon")) for t in clean) > 0.7


def test_pairs_are_found_beside_strong_single_terms_by_brute_force():
    rnd = np.random.default_rng(7)
    texts = [np.sort(rnd.choice(np.arange(1, 400, 2), 40, replace=False)) for _ in range(600)]
    residual = rnd.normal(size=600) + np.array([1.2 if {1, 3} <= set(t.tolist()) else 0 for t in texts])
    x = T._matrix(texts, np.arange(1, 400, 2))
    words, alone = np.arange(1, 400, 2), np.abs(x.T @ residual) / x.sum(0)
    for z in (3.0, 4.0):
        want = set()
        for i in range(words.size):
            for j in range(i):
                both = (x[:, i] * x[:, j]) > 0
                if x[:, i].sum() < z * z or x[:, j].sum() < z * z or not both.any():
                    continue
                if abs(residual[both].sum()) - both.sum() * max(alone[i], alone[j]) >= z * np.sqrt((residual[both] ** 2).sum()):
                    want |= {words[i], words[j]}
        assert set(T.pair_terms(texts, residual, z).tolist()) == want


def test_terms_are_words_and_stems_of_the_whole_text():
    a, b = set(T.text_terms("Idiotic.")), set(T.text_terms("idiots"))
    assert a & b == set(T.word_terms("idiotic")[1:]) & set(T.word_terms("idiots")[1:]) and len(a & b) == 3
    assert set(T.text_terms("x " * 50_000 + "last")) >= set(T.word_terms("last")) and T.text_terms("").size == 0


def test_held_out_quality_on_the_table(spark):
    from tessera.llm.util import table
    docs, labels = table(spark, TABLES, "documents"), table(spark, TABLES, "labels")
    got = T.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.predicted for r in got])
    assert (p & y).sum() / p.sum() > 0.95 and (p & y).sum() / y.sum() > 0.8
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_never_learned(spark):
    from pyspark.sql import functions as F
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 2, F.lit(" n"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a.terms.size and (a.terms == b.terms).all() and (a.w == b.w).all()


def test_nulls_empty_one_label_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 0.5, 1), (2, "", 0.5, 1), (2, "", 0.5, 1), (None, "stupid", 0.5, 1), (5, "a " * 40_000, 0.5, 1)],
                                 "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id or 0, r.score < 1e-9, r.predicted) for r in got.collect()) == [(0, True, 0), (1, True, 0), (2, True, 0), (2, True, 0), (5, True, 0)]
    kept = T.drop_toxic(docs, T.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == 5
    assert T.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    rows = [(i, f"{'foul' if i % 2 else 'fine'} t{i} {k}") for i in range(60) for k in range(6)] + [(3, f"foul t3 {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic").distinct()
    sizes, fit = [], T.fit
    monkeypatch.setattr(T, "fit", lambda texts, y, *a, **k: sizes.append(len(texts)) or fit(texts, y, *a, **k))
    T.train(docs, labels, sample_docs=10)
    T.train(docs, labels)
    assert 0 < sizes[0] <= 10 and sizes[0] < sizes[1] <= 60
