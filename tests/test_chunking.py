from tessera.operators import kb_text as K


def docs(spark, texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, tenant_id int, content string")


def test_fixed_chunks_boundaries(spark):
    texts = ["", "short", "x" * 800, "y" * 801, "z" * 1480, "w" * 1481]
    got = {r.doc_id: r.n for r in K.chunk_documents(docs(spark, texts)).groupBy("doc_id").count()
           .withColumnRenamed("count", "n").collect()}
    assert 0 not in got                      # empty text: no chunk
    assert got[1] == 1 and got[2] == 1       # up to 800 chars: one chunk
    assert got[3] == 2 and got[4] == 2 and got[5] == 3


def test_fixed_chunks_cover_text(spark):
    t = "".join(chr(65 + i % 26) for i in range(2000))
    rows = sorted(K.chunk_documents(docs(spark, [t])).collect(), key=lambda r: r.chunk_no)
    assert [r.start for r in rows] == [0, 680, 1360]
    assert all(len(r.chunk) <= 800 for r in rows)
    assert rows[-1].chunk.endswith(t[-10:])
    assert rows[1].chunk[:120] == rows[0].chunk[-120:]   # 120 characters of overlap


def test_recursive_splitter():
    text = ("para one line\n" * 30) + "\n\n" + ("word " * 400) + "\n\n" + "nospace" * 200
    parts = K.split_recursive(text, 800, 120)
    assert all(len(c) <= 800 for _, c in parts)
    assert parts[0][0] == 0
    # every character of the text is in some chunk, in order
    joined_end = max(s + len(c) for s, c in parts)
    assert joined_end == len(text)
    for s, c in parts:
        assert text[s:s + len(c)] == c
    assert K.split_recursive("", 800, 120) == []
    assert K.split_recursive("abc", 800, 120) == [(0, "abc")]


def test_recursive_form_matches_helper(spark):
    t = "alpha beta\n\n" * 200
    got = K.chunk_documents_recursive(docs(spark, [t])).orderBy("chunk_no").collect()
    assert [(r.start, r.chunk) for r in got] == K.split_recursive(t, 800, 120)


def test_sections(spark):
    md = "intro text\n# First\nbody one\n## Second\nbody two"
    html = "<p>pre</p><h2>Fees</h2><p>a</p><h2 class='x'>Hours</h2><p>b</p>"
    rows = K.split_sections(docs(spark, [md, html])).orderBy("doc_id", "section_no").collect()
    assert [r.heading for r in rows if r.doc_id == 0] == [None, "First", "Second"]
    assert [r.heading for r in rows if r.doc_id == 1] == [None, "Fees", "Hours"]


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<html><head><title>A &amp; B</title><script>var x='<p>';</script>"
                                       "<style>p{}</style></head><body><h1>Hi</h1><!-- c --><p>x &lt; y</p></body></html>")],
                               "page_id long, url string, html string")
    r = K.extract_pages(df).first()
    assert r.title == "A & B"
    assert r.text == "Hi x < y"


def test_reindex_actions(spark):
    old = docs(spark, ["same text", "old text", "gone"])
    new = spark.createDataFrame([(0, 1, "same text"), (1, 1, "new text"), (3, 1, "brand new")],
                                "doc_id long, tenant_id int, content string")
    plan, chunks = K.reindex(new, old, K.chunk_documents(old))
    got = {r.doc_id: r.action for r in plan.collect()}
    assert got == {0: "unchanged", 1: "changed", 2: "removed", 3: "new"}
    ch = {(r.doc_id, r.chunk) for r in chunks.collect()}
    assert ch == {(0, "same text"), (1, "new text"), (3, "brand new")}


def test_passages_and_evaluation(spark):
    d = spark.createDataFrame([(1, 1, "the visiting hours are ten to seven daily"), (2, 1, "hours are ten"),
                               (3, 2, "the visiting hours are ten to seven")], "doc_id long, tenant_id int, content string")
    q = spark.createDataFrame([(10, 1, "Visiting hours are ten!"), (11, 1, "no such passage here")],
                              "query_id long, tenant_id int, query_text string")
    m = sorted((r.query_id, r.doc_id) for r in K.passage_matches(d, q).collect())
    assert m == [(10, 1)]                           # doc 3 is another tenant's
    hits = spark.createDataFrame([(10, 2, 1), (10, 1, 2), (11, 1, 1)], "query_id long, doc_id long, rank int")
    ev = {r.query_id: r for r in K.evaluate(hits, K.passage_matches(d, q), q, 3).collect()}
    assert ev[10].n_expected == 1 and ev[10].recall_at_k == 1.0 and ev[10].reciprocal_rank == 0.5
    assert not ev[11].answerable and ev[11].recall_at_k is None


def test_read_kb_files(spark, tmp_path):
    root = tmp_path / "tenants" / "7"
    root.mkdir(parents=True)
    (root / "hours.md").write_text("# Hours\nOpen 9-5\n")
    (root / "fees.csv").write_text("item,price\nvisit,10\n")
    txt = K.read_kb_files(spark, str(tmp_path / "tenants" / "7" / "*.md"), "md").collect()
    assert [(r.tenant_id, r.title, r.text) for r in txt] == [("7", "hours", "# Hours\nOpen 9-5\n")]
    csv = K.read_kb_files(spark, str(tmp_path / "tenants" / "7" / "*.csv"), "csv").collect()
    assert [(r.tenant_id, r.text) for r in csv] == [("7", "item: visit; price: 10")]


def test_registered_recursive_chunking_matches_brute_force(spark, sf):
    """The registered query over the whole smallest documents table against
    the splitter run directly on every document."""
    import pyarrow.parquet as pq

    import __spark_entry__ as E
    got = sorted((r.doc_id, r.chunk_no, r.start, r.chunk)
                 for r in E.queries()["k1_chunk_documents_recursive"](spark, sf).collect())
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted((d["doc_id"], i, s, c) for d in t for i, (s, c) in enumerate(K.split_recursive(d["text"] or "")))
    assert got == want and len(want) > len(t)


def test_batch_splitter_equals_the_one_text_splitter():
    import random
    rnd = random.Random(6)
    texts = ["", "abc", "x" * 5000, " " * 3000, "\n" * 2500, "\n\n\n" * 900, "a" * 799 + " " + "b" * 801]
    for _ in range(300):
        alphabet = rnd.choice(["ab \n", "a\n\n", "é😀 \n\n", "abcdefgh ", "x"])
        texts.append("".join(rnd.choice(alphabet) * rnd.choice((1, 1, 2, 3, 40, 400)) for _ in range(rnd.randrange(60))))
    for size, overlap in ((800, 120), (50, 0), (50, 49), (7, 3), (1, 0)):
        some = texts if size > 10 else [t[:600] for t in texts]
        doc, number, start, end = K.split_batch(some, size, overlap)
        got = {}
        for d, n, a, b in zip(doc.tolist(), number.tolist(), start.tolist(), end.tolist()):
            assert n == len(got.setdefault(d, []))
            got[d].append((a, some[d][a:b]))
        for i, t in enumerate(some):
            assert got.get(i, []) == K.split_recursive(t, size, overlap), (size, overlap, t[:80])


def test_batch_splitter_on_the_table(spark):
    from tessera.sources import views as V
    from tessera.sources.tables import Tables
    docs = V.docs(Tables(spark, "/root/testdata/sf0.01"))
    want = {(r.doc_id, i): c for r in docs.select("doc_id", "content").collect() for i, c in enumerate(K.split_recursive(r.content or ""))}
    got = {(r.doc_id, r.chunk_no): (r.start, r.chunk) for r in K.chunk_documents_recursive(docs).collect()}
    assert got == want
