import numpy as np

import corpus_pipeline as P
from tessera.llm import language_id as L
from tessera.llm import toxicity as T
from tests.llm.test_near_dedup import brute_groups
from tests.llm.test_packing import check, hf  # noqa: F401 - a fixture


def brute(spark, sf):
    """The texts that the first four stages leave, on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model, left = L.train(docs), {}
    for d, t in rows.items():
        if t and L.LETTER.search(t):
            _, _, unsure = model.decode(model.margins(L.ngram_counts(t)[None]))
            if not unsure[0]:
                left[d] = t
    kept = docs.filter(docs.doc_id.isin(list(left)))
    tox = T.train(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    rows_of = T.TermRows(tox.terms)
    left = {d: t for d, t in left.items() if tox.score(rows_of.of(t)) < T.THRESHOLD}
    last = {}
    for d in sorted(left):
        last[left[d]] = d
    left = {d: t for t, d in last.items()}
    groups = brute_groups(sorted(left.items()))
    return {d: t for d, t in left.items() if groups[d] == d}


def test_run_against_brute_force(spark, sf, hf):  # noqa: F811
    want = brute(spark, sf)
    assert 0 < len(want) < 200
    assert check(P.run(spark, sf).collect(), want, hf, 2048) < 0.05


def test_stages_return_the_columns_of_docs_and_take_empty_tables(spark, sf):
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert P.pack_windows(spark, docs, sf).count() == 0


def test_clean_documents_pass_the_filters(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in P.identify_language(spark, docs, sf).select("doc_id").collect()}
    assert len(kept) >= 0.98 * docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    after = {r.doc_id for r in P.remove_toxic(spark, docs, sf).select("doc_id").collect()}
    clean = [d for d, y in labels.items() if y == 0]
    assert np.mean([d in after for d in clean]) > 0.97


def test_stages_take_nulls_repeated_ids_and_extra_columns(spark, sf):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.when(F.col("doc_id") >= 0, "x")).withColumn("_text", F.col("doc_id") * 2).withColumn("score", F.lit(None).cast("int"))
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "y", 1, 1), (1, None, None, None, None, "y", 1, 1),
                                 (5_000_001, "!!! 123", "en", "s", 7, "z", 1, 1)], docs.schema)
    twice = docs.filter("doc_id < 40")                            # rows that repeat an id and a text
    both = docs.unionByName(odd).unionByName(twice)
    sizes = [both.count()]
    for name, stage in P.STAGES[:-1]:
        out = P.materialize(stage(spark, both, sf))
        assert out.columns == docs.columns, name
        assert out.exceptAll(both).isEmpty(), name                 # rows are kept or dropped, never changed
        sizes.append(out.count())
        both = out
    assert both.filter("text is null or text in ('', '!!! 123')").isEmpty()            # no language
    assert both.count() == both.select("text").distinct().count() and sizes == sorted(sizes, reverse=True)
    packed = P.pack_windows(spark, both, sf)
    assert packed.select("doc_id").distinct().count() == both.count()
