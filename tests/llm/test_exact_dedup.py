import pytest

from tessera.llm.exact_dedup import drop_copies, exact_dedup, refine
from tessera.llm.util import key_bitmap, mark_members, without_ids

SCHEMA = "doc_id long, text string, kept string, _len int"


def rows(spark):
    same = "x" * 80
    return spark.createDataFrame([
        (1, "a", "e", 1), (2, "a", "f", 2), (3, None, None, None), (4, "", "g", 1), (5, same + "1", "h", 1), (6, same + "2", "i", 1),
        (7, same + "1", "j", 1), (7, same + "1", "j", 1), (None, "b", "k", 1), (9, "B", "l", 1), (10, "long " * 50_000, "m", 1)], SCHEMA)


def test_groups_with_nulls_empties_repeats_and_clashing_names(spark):
    got = sorted(map(tuple, exact_dedup(rows(spark)).collect()), key=str)
    assert got == sorted([
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 7, 3, False), (6, 6, 1, True), (7, 7, 3, True),
        (7, 7, 3, False), (None, None, 1, True), (9, 9, 1, True), (10, 10, 1, True)], key=str)


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    out = drop_copies(rows(spark))
    assert out.columns == ["doc_id", "text", "kept", "_len"]
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 4, 6, 7, 9, 10]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_digest_of_whole_text(spark):
    import hashlib
    got = {r.doc_id: r.text_sha256 for r in exact_dedup(rows(spark), digest=True).collect()}
    assert got[10] == hashlib.sha256(b"long " * 50_000).hexdigest() and got[3] == hashlib.sha256(b"").hexdigest()


def test_only_survivors_get_the_full_digest(spark):
    from pyspark.sql import functions as F
    base = rows(spark).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    got = {r._id: (r._prefix is not None, r._full is not None) for r in refine(base).collect()}
    assert got[10] == (False, False)          # a length of its own
    assert got[9] == (True, False)            # length shared, prefix not
    assert got[6] == (True, True)             # length and prefix shared, text not


@pytest.mark.parametrize("bits", [15, 16])
def test_bitmap_has_no_false_negative(spark, bits):
    keys = spark.range(0, 5000, 7)
    marked = mark_members(spark.range(5000), key_bitmap(keys, "id", bits=bits), "id", name="hit", bits=bits)
    hits = {r.id for r in marked.filter("hit").collect()}
    assert set(range(0, 5000, 7)) <= hits and len(hits) < 5000


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id long, _bucket string")
    gone = spark.createDataFrame([(2,), (2,)], "doc_id long")
    assert sorted(map(str, without_ids(docs, gone).collect())) == ["Row(doc_id=1, _bucket='a')", "Row(doc_id=None, _bucket='c')"]
