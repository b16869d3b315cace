import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import license_texts
from tessera.llm.license_scan import known_licenses, license_scan

MIT = next(t for i, t in license_texts.KNOWN if i == "MIT")
SCHEMA = "doc_id long, text string, license_id int, digest string"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in license_scan(docs, known_licenses(spark)).collect()}


def test_whole_text_up_to_case_punctuation_copyright_and_spelling(spark):
    varied = "Copyright (c) 2020 Some One\n© 2021 Other\nAll rights reserved.\n" + MIT.upper().replace("MIT LICENSE", "mit licence ").replace(",", " ;")
    got = scan(spark, [MIT, varied, MIT + " Extra.", "", None, "!!!", "a\nReleased under the MIT licence\nb\nLicensed under CC BY-NC 4.0."])
    assert got[0].license_id == "MIT" and got[1].license_id == "MIT" and got[0].text_digest == got[1].text_digest
    assert got[2].license_id is None and got[3].license_id is None and got[4].text_digest == got[5].text_digest == got[3].text_digest
    assert (got[6].notice_ids, got[6].n_notices, got[6].license_id) == ("CC-BY-NC-4.0,MIT", 2, None)
    assert len(got) == 7


def test_body_lines_that_mention_copyright_stay(spark):
    got = scan(spark, ["The above copyright notice stays.", "The above stays."])
    assert got[0].text_digest != got[1].text_digest


def test_native_plan_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, MIT), (1, MIT)], "doc_id long, text string")
    out = license_scan(docs, known_licenses(spark))
    assert [r.license_id for r in out.collect()] == ["MIT", "MIT"]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert license_scan(docs.limit(0), known_licenses(spark)).count() == 0


def canonical_texts(spark, texts):
    from tessera.llm.license_scan import canonical
    return [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical(F.col("t")).alias("c")).sort("i").collect()]


def test_spellings_change_whole_words_only(spark):
    got = canonical_texts(spark, ["centre centre Centre", "epicentre colourful", "sub-license Sub\nLicense", "copyright\nowner http://x", "licence\nlicences"])
    assert got == ["center center center", "epicentre colourful", "sublicense sublicense", "copyright holder https x", "license licenses"]


def test_inputs_out_of_a_shuffle(spark):
    texts = [MIT, "a\nReleased under the MIT licence.", "plain", "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.", None]
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    want = {0: ("MIT", "", 0), 1: (None, "MIT", 1), 2: (None, "", 0), 3: (None, "CC-BY-4.0", 2), 4: (None, "", 0)}
    other = spark.range(n).withColumnRenamed("id", "doc_id")
    for rows in (docs.repartition(16), docs.unionByName(docs).dropDuplicates(["doc_id"]), docs.join(other.repartition(7), "doc_id")):
        got = license_scan(rows, known_licenses(spark), fixed=license_texts.DIGESTS).collect()
        assert len(got) == n and all((r.license_id, r.notice_ids, r.n_notices) == want[r.doc_id % 5] for r in got)


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"),
                                        ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")])
def test_long_public_licences(spark, file, name):
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("the public texts are not on this machine")
    text = open(path, encoding="utf-8").read()
    docs = spark.createDataFrame([(1, text), (2, "Copyright (c) 2024 A. Body\n" + text.upper().replace(". ", " - ")), (3, text + " more")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan(docs, known_licenses(spark), fixed=license_texts.DIGESTS).collect()}
    assert got == {1: name, 2: name, 3: None}


def test_ties_very_long_texts_and_no_known_licence(spark):
    known = known_licenses(spark, [("B", "Some  terms."), ("A", "some terms"), ("C", "...")])
    docs = spark.createDataFrame([(1, "SOME TERMS"), (2, "some terms\n" * 100_000), (3, "word " * 400_000)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notice_ids, r.n_notices) for r in license_scan(docs, known).collect()}
    assert got == {1: ("A", "A", 1), 2: (None, "A", 100_000), 3: (None, "", 0)}
    nothing = license_scan(docs, known.limit(0)).collect()
    assert {(r.license_id, r.notice_ids, r.n_notices) for r in nothing} == {(None, "", 0)} and len(nothing) == 3
