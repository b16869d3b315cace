import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as D

SCHEMA = "doc_id long, text string, _pos int, _k1 string, keep_bitmap string"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs, min_chars=1):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    hot = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    for doc_id, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        yield doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)


def run(docs, **kw):
    got = D.drop_lines(docs, D.line_bitmaps(docs, **kw)).collect()
    return sorted((tuple(r) for r in got), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("width", [1, 8, 64])
@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_same_as_counting_every_line(spark, width, min_docs):
    rnd = random.Random(width)
    words = ["Menu", "menu ", "\tMENU", "home", "  ", "", "İ", "ß", "a b", "\x0b", " menu"]
    rows = [(i % 50, "\n".join(rnd.choice([*words, f"only {i} {j}"]) for j in range(rnd.randrange(12)))) for i in range(80)]
    rows += [(3, "Menu\nx"), (3, "Menu\nx"), (None, "home"), (None, "home"), (70, None), (71, ""), (72, "menu\n" * 30_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = run(frame(spark, rows), min_docs=min_docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute(rows, min_docs), key=str)


def test_a_line_of_a_third_of_all_rows_spans_partitions(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = [(i, "Hot\n" * (1 + i % 2) + f"cold {i}" + ("\nrare" if i < 9 else "") + ("\nten" if i < 10 else "")) for i in range(600)]
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = frame(spark, rows)
        spread = D.line_rows(docs, "doc_id", "text").repartitionByRange(*D.KEY, *D.DOC).withColumn("p", F.spark_partition_id())
        assert spread.groupBy(*D.KEY).agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] > 5
        assert run(docs) == sorted(brute(rows, 10), key=str)
        first = run(docs, keep="first")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    kept = Counter(key(x) for r in first for x in r[3].split("\n"))
    assert kept["hot"] == 1 and kept["ten"] == 1 and kept["rare"] == 9


def test_min_chars_and_short_keys(spark):
    rows = [(i, f"ab\nabc\n{i}") for i in range(12)]
    assert run(frame(spark, rows), min_chars=3) == sorted(brute(rows, 10, 3), key=str)


def test_bitmaps_hold_no_text_and_are_compressed(spark):
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(4000)] + ["same"] * 4000)) for i in range(10)]
    got = D.line_bitmaps(frame(spark, rows)).collect()
    assert len(got) == 10 and all(len(r.keep_bitmap) < 60 and r.n_dropped == 4000 for r in got)


def test_rows_out_of_a_shuffle(spark):
    rows = [(i, f"same\nown {i}") for i in range(40)]
    for docs in (frame(spark, rows).repartition(7), frame(spark, rows + rows).dropDuplicates(["doc_id"])):
        assert run(docs) == sorted(brute(rows, 10), key=str)


def test_empty_table(spark):
    assert run(frame(spark, [])) == []
