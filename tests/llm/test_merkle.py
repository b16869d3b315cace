import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.ranking import ranked
from tessera.llm.util import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _g string, path int, hash string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, w in enumerate(at):
            a = w // 16 * 16
            paths[k].append(("".join(hashes[a:w]), "".join(hashes[w + 1:a + 16])))
            at[k] = w // 16
        hashes = [digest(*hashes[i:i + 16]) for i in range(0, len(hashes), 16)]
    return hashes[0], paths


def brute(rows):
    by = {}
    for doc_id, source, lang, n, text in rows:
        changed = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, again = (digest(*map(enc, (doc_id, source, lang, n, t))) for t in (text, changed))
        by.setdefault(source, []).append((doc_id, leaf, again))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in by[s]]) for s in names]
    root, across = tree([t[0] for t in trees])
    for s, (sub, inside), far in zip(names, trees, across):
        for (doc_id, leaf, node), near in zip(by[s], inside):
            for left, right in near + far:
                node = digest(left, node, right)
            yield doc_id, leaf, sub, root, digest(*[a + b for a, b in near + far]), node, node == root


def agree(docs):
    got = [tuple(r) for r in merkle.audit(docs).collect()]
    want = list(brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_whole_table(spark):
    got = agree(table(spark, "/root/testdata/sf0.01", "documents"))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 16), (17, 256, 257), (4096, 1), (4097, 33)])
def test_trees_of_every_height(spark, sizes):
    rows = [(i, f"Text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    agree(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_many_sources(spark):
    agree(spark.createDataFrame([(i, "A", "en", f"{i:x}é", 1) for i in range(4500)], "doc_id long, text string, lang string, source string, n_chars long"))


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    rows = [(1, "A b", "en", None, 3, "x", 1, "h"), (1, "A b", "en", None, 3, "y", 2, "i"), (None, None, None, None, None, None, None, None),
            (5, "", "", "", 0, "", 0, ""), (8, None, "en", "", 0, "", 0, ""), (9, "Ünï" * 60_000, "de", "é", 1, "", 0, ""),
            (None, "A", "en", "z", 1, "", 0, ""), (3, "ABC", "en", "z", 1, "", 0, ""), (3, "abc", "en", "z", 1, "", 0, "")] + [(7, "same", "en", "hot", 4, "", 0, "")] * 300
    agree(spark.createDataFrame(rows, SCHEMA))


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_changed_field_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = merkle.manifest(docs, tampered=F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    bad = rows.filter(merkle.fold(F.col("checked"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [7]


def test_ranks_do_not_depend_on_the_number_of_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("_g"), (F.col("id") * 7919 % 3001).alias("k"))
    for n in (1, 7, 40):
        got = ranked(rows.repartition(n), "_g", ["k"]).collect()
        for g in "012":
            mine = sorted((r.k, r._rank, r._n) for r in got if r._g == g)
            assert [r[1] for r in mine] == list(range(1000)) and {r[2] for r in mine} == {1000}
