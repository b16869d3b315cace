import numpy as np

from tessera.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score int, _text int"


def test_codes_correct_errors():
    for k in (3, 4, 7, 12):
        code = L.code_matrix(k)
        assert len({tuple(r) for r in code}) == k and set(np.unique(code)) == {-1, 1}
        assert L.min_distance(code) >= (2 ** (k - 2) if k <= 7 else 3)


def test_decoding_repairs_a_wrong_bit_and_flags_a_far_word():
    code = L.code_matrix(4)
    m = L.LanguageModel(list("abcd"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape))
    margins = 4 * code.copy()
    margins[:, 0] *= -1
    best, score, amb = m.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.5).all() and not amb.any()
    assert m.decode(np.zeros((1, code.shape[1])))[2].all()


def test_counts_by_brute_force():
    f = L.ngram_counts("Ab,  cé")
    b = " ab cé ".encode()
    want = np.zeros_like(f)
    for n in L.ORDERS:
        grams = [b[i:i + n] for i in range(len(b) - n + 1)]
        for g in grams:
            code = int.from_bytes(g, "big") & 0xFFFFFFFF
            want[(((code + n * 0x9E37) * 2654435761) & 0xFFFFFFFF) >> (32 - L.DIM_BITS)] += 1 / len(grams)
    assert np.allclose(f, want)


def test_held_out_accuracy_on_the_table(spark):
    from tessera.llm.util import table
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    assert np.mean([r.ambiguous for r in got]) < 0.02 and all(0 <= r.score <= 1 for r in got)


def test_nulls_no_letters_empty_model_and_kept_columns(spark):
    rows = [(1, None, "en", 1, 1), (2, "", "en", 1, 1), (3, "123 !?", "en", 1, 1), (4, "the and of", "en", 1, 1), (4, "the and of", "en", 1, 1),
            (None, "der die das", "de", 1, 1), (6, "word " * 30_000, None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = {(r.doc_id, r.lang_pred, r.score) for r in L.language_id(docs).collect()}
    assert (1, "und", 0.0) in one and (3, "und", 0.0) in one and (4, "en", 1.0) in one and (6, "en", 1.0) in one
    kept = L.keep_identified(docs, L.train(docs))
    assert kept.columns == docs.columns and kept.count() == 4
    none = L.language_id(docs.filter("lang is null"))
    assert [r.lang_pred for r in none.collect()] == ["und"]
    assert L.language_id(docs.limit(0)).count() == 0


def test_sample_is_bounded_even_and_fixed(spark):
    from pyspark.sql import functions as F
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") < 20, "tiny").otherwise("many").alias("y"))
    got = L.sample_ids(rows, "id", "y", 300)
    again = L.sample_ids(rows.repartition(7), "id", "y", 300)
    n = {y: sum(1 for _, z in got if z == y) for y in ("rare", "tiny", "many")}
    assert got == again and len(got) == 300 and n["tiny"] == 18 and n["rare"] == n["many"] == 141


def test_repeated_ids_leave_no_language_out(spark):
    words = {"aa": "alpha apple amber", "zz": "zulu zebra zinc"}
    rows = [(i, f"{words[x]} {k}", x, 1, 1) for n, x in enumerate(words) for i in range(100 * n, 100 * n + 40) for k in range(6)]
    rows += [(7, f"hot alpha {k}", "aa", 1, 1) for k in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    m = L.train(docs, sample_docs=20)
    assert m.langs == ["aa", "zz"]
    one = L.one_text(docs.drop("_text").withColumnRenamed("text", "_text"), "doc_id", "lang")
    assert one.count() == 80 and sorted(one.collect()) == sorted(L.one_text(docs.repartition(5).drop("_text").withColumnRenamed("text", "_text"), "doc_id", "lang").collect())


UNSEEN = ["Это обычное русское предложение о погоде и природе.", "Αυτή είναι μια απλή ελληνική πρόταση για τον καιρό.", "これは日本語の文章です。今日は天気がいいですね。",
          "这是一个简单的中文句子，今天天气很好。", "هذه جملة عربية بسيطة عن الطقس", "이것은 간단한 한국어 문장입니다", "यह मौसम के बारे में एक सरल वाक्य है"]


def test_unseen_scripts_and_random_letters_are_flagged_and_clean_documents_are_not(spark):
    import random
    from tessera.llm.util import table
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = L.train(docs)
    rnd = random.Random(4)
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randrange(40, 600))) for _ in range(300)]
    strange = spark.createDataFrame([(i, t * k, None) for i, t in enumerate(noise + UNSEEN) for k in (1, 4)], "doc_id long, text string, lang string")
    flagged = [r.ambiguous for r in L.identify(strange, model).collect()]
    assert np.mean(flagged) >= 0.9 and np.mean(flagged[-2 * len(UNSEEN):]) >= 0.9
    clean = L.identify(docs, model).collect()
    assert np.mean([r.ambiguous for r in clean]) <= 0.02
    both = docs.unionByName(strange)
    kept = L.keep_identified(both, model)
    assert kept.count() <= docs.count() + 0.1 * strange.count() and kept.count() >= 0.98 * docs.count()


def test_distance_counts_margins_against_the_usual_ones():
    code = L.code_matrix(4)                      # distance 4: flagged from 1.6 bits on
    m = L.LanguageModel(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones(code.shape), np.full(7, 2.0))
    margins = np.repeat(2 * code[:1], 6, 0)
    margins[1, :3] = 0
    margins[2, :4] = 0
    margins[3, 0], margins[3, 1] = -margins[3, 0], 0
    margins[4, 0], margins[4, 1:3] = -margins[4, 0], 0
    margins[5] *= 0.25
    assert m.distance(margins, np.zeros(6, int)).tolist() == [0, 1.5, 2, 1.5, 2, 2.625]
    assert m.decode(margins)[2].tolist() == [False, False, True, False, True, True]
