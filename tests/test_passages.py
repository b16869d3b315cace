"""Retrieval by passage over whole texts, and the stored vectors."""

import os

from pyspark.sql import functions as F

from tessera.operators import kb_search as S
from tessera.operators import kb_text as K
from tessera.operators import passages as P
from tessera.operators import vector_store as VS

DOCS = "doc_id long, tenant_id int, title string, source string, content string"
Q = "query_id long, tenant_id int, query_text string"


def corpus(spark):
    filler = "the office is open and the staff is friendly today " * 200
    rows = [(1, 1, "Long", "a", filler + " parking costs seven crowns behind the chapel " + filler),
            (2, 1, "Other", "b", "the chapel is closed " + filler), (3, 1, "Empty", "c", None), (4, 2, "Foreign", "d", "parking costs seven crowns behind the chapel")]
    return spark.createDataFrame(rows, DOCS)


def test_the_only_match_lies_after_five_thousand_characters(spark):
    docs = corpus(spark)
    at = docs.filter("doc_id = 1").first().content.index("parking")
    assert at > 5000
    asked = spark.createDataFrame([(7, 1, "What does parking cost, crowns?")], Q)
    hits = P.passage_texts(P.search_passages(asked, docs, 2), docs)
    top = hits.filter("rank = 1").first()
    assert top.doc_id == 1 and "parking costs seven crowns" in top.chunk and top.chunk_no * 680 <= at < top.chunk_no * 680 + 800
    assert {r.doc_id for r in hits.collect()} <= {1, 2}        # tenant 2's copy isn't searched


def test_context_holds_the_chunk_that_matched_by_vector(spark, tmp_path):
    docs = corpus(spark)
    chunks = P.passages(docs)
    vecs = VS.refresh(chunks, str(tmp_path / "v"), VS.hash_embedder(256), "hash", "1", text_col="chunk")
    asked = K.hash_embed(spark.createDataFrame([(7, 1, "parking costs seven crowns behind the chapel")], Q), ["query_id", "tenant_id"], "query_text", 256) \
        .withColumnRenamed("embedding", "query_vec")
    hits = S.search(asked, VS.with_vectors(chunks, vecs, text_col="chunk"), 1, keep=("doc_id", "chunk_no"))
    ctx = S.build_context(asked, P.passage_texts(hits, docs).withColumnRenamed("chunk", "content"), 0.1).first()
    assert "parking costs seven crowns" in ctx.context and ctx.sources == ["Long"]


def test_a_documents_score_is_that_of_its_best_chunk(spark):
    docs = spark.createDataFrame([(1, 1, "t", "s", "apple " + "x " * 900 + "apple apple pear"), (2, 1, "t", "s", "pear " * 3), (3, 1, "t", "s", "plum")], DOCS)
    asked = spark.createDataFrame([(1, 1, "apple pear"), (2, 1, "apple pear"), (3, 9, "apple")], Q)
    got = P.search_passages(asked, docs, 5).collect()
    one = sorted((r.rank, r.doc_id, r.chunk_no) for r in got if r.query_id == 1)
    assert one == sorted((r.rank, r.doc_id, r.chunk_no) for r in got if r.query_id == 2)     # equal questions
    assert {(d, c) for _, d, c in one} == {(1, 2), (2, 0)} and not [r for r in got if r.query_id == 3]
    by_chunk = K.keyword_search(asked.filter("query_id = 1"), P.passages(docs), 9, id_col="chunk_id", text_col="chunk").collect()
    best = {}
    for r in by_chunk:
        d = int(r.chunk_id.split(":")[0])
        best[d] = max(best.get(d, 0), r.score)
    assert best == {r.doc_id: r.score for r in got if r.query_id == 1}


def no_rows(df):
    """An embedder that must not be given a text."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                raise AssertionError("embedded again")
        yield from ()
    return df.mapInArrow(run, "content_key string, embedding array<double>")


def files(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_a_second_search_embeds_nothing_and_changes_embed_only_themselves(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, 1, "t", "s", f"text {i % 7}") for i in range(40)] + [(90, 1, "t", "s", None), (91, 1, "t", "s", "")], DOCS)
    first = VS.refresh(docs, path, VS.hash_embedder(), "hash", "1")
    assert first.count() == 8                                   # equal texts once; null as empty
    written = files(path)
    again = VS.refresh(docs.repartition(5), path, no_rows, "hash", "1")
    assert files(path) == written and again.count() == 8
    found = VS.with_vectors(docs.select("doc_id", "content"), again)
    assert found.count() == 42 and found.filter("embedding is null").count() == 0
    changed = docs.unionByName(spark.createDataFrame([(99, 1, "t", "s", "new text")], DOCS))
    assert [r.content for r in VS.missing(changed, path, "hash", "1").collect()] == ["new text"]
    VS.refresh(changed, path, VS.hash_embedder(), "hash", "1")
    assert set(written) < set(files(path)) and VS.read_vectors(spark, path, "hash", "1").count() == 9


def test_a_new_model_version_embeds_all_and_keeps_the_old(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = corpus(spark)
    VS.refresh(docs, path, VS.hash_embedder(64), "hash", "1")
    assert VS.missing(docs, path, "hash", "2").count() == 4
    new = VS.refresh(docs, path, VS.hash_embedder(32), "hash", "2")
    assert {len(r.embedding) for r in new.collect()} == {32} and VS.read_vectors(spark, path, "hash", "1").count() == 4
    want = {r.doc_id: r.embedding for r in K.hash_embed(docs, ["doc_id"], "content", 32).collect()}
    got = {r.doc_id: r.embedding for r in VS.with_vectors(docs.select("doc_id", "content"), new).collect()}
    assert got == want


def test_empty_tables(spark, tmp_path):
    none, asked = corpus(spark).limit(0), spark.createDataFrame([(1, 1, "x")], Q)
    assert P.search_passages(asked, none, 3).count() == 0 and P.passage_texts(P.search_passages(asked, none, 3), none).count() == 0
    assert VS.refresh(none, str(tmp_path / "s"), VS.hash_embedder(), "hash", "1").count() == 0
