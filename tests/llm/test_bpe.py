import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import codec, decode, encode, round_trip
from tessera.llm.util import tokenizer_path


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


HF = library()
ODD = ["", " ", "Hello it's Éa ΣΑΣ", "<|endoftext|> a<|startoftext|>B", "a\x1cb\x00c", "İstanbul ß ﬁ", "é 漢字 🙂👍", "don't we'll 12,345.67", "a" * 3000,
       "x\xa0y z​", "aabaabaabaab" * 40, "!!!???--==>", "the THE thething"]


def same(text):
    c = codec()
    ids = c.encode(text).tolist()
    want = HF.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:60]
    assert c.decode(c.encode(text)) == HF.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abehinorst'", min_size=1, max_size=30))
def test_words(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    same("".join(c for c in text if not 0xD800 <= ord(c) < 0xE000))


def test_whole_table_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = round_trip(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = HF.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(HF.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_frames_nulls_repeats_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "Ab c", 2), (2, "Ab c", 2), (None, "", 3)], "doc_id long, text string, ids int")
    ids = encode(docs)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in ids.collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert sorted(r.text for r in decode(ids).collect()) == ["", "", "ab</w> c</w>", "ab</w> c</w>"]
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.ids_sha256, r.decoded_sha256) for r in round_trip(docs).collect() if not r.n_tokens} == {(empty, empty)}
    assert round_trip(docs.limit(0)).count() == 0
