import hashlib
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe
from gridloom.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.BpeTokenizer(PATH, cache=64)  # so small that entries are forgotten all the time


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


assigned = st.characters(min_codepoint=0, max_codepoint=0x24FF, exclude_categories=["Cn", "Cs", "Mn", "Mc", "Co"])


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(st.sampled_from("abehinorst 'dlmrstv09!#.\n\tÉéßΣσ\x1c\x85<|>"), max_size=30), st.text(assigned, max_size=20), st.text(st.sampled_from("ab"), max_size=40)))
def test_random_texts(own, library, text):
    check(own, library, text)


def test_odd_texts(own, library):
    for text in ["", " ", "Hello <|endoftext|> it's<|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΑΣ", "don'T we'RE", "z" * 3000, "é é", "😀 汉字 ﬁ", "\x00a\u2028b\xa0c", "12345 a_b-c", unicodedata.normalize("NFD", "Éclair ñandú")]:
        check(own, library, text)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 100_000), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as id", "1 as n_tokens")
    encoded = bpe.encode_documents(df, PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encoded.collect()) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1), (3, 100_000)]
    back = {(r.doc_id or 0, r.decoded) for r in bpe.decode_documents(encoded, PATH).collect()}
    assert (0, "a</w> b</w>") in back and (1, "") in back
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.BpeTokenizer(tokenizer_file("byte_bpe_50k.json"))


def test_letters_newer_than_the_interpreter(own, library):
    """Capital letters of later Unicode versions, unassigned characters and what stands around them."""
    for text in ["A\u1c89B \u1c8a \ua7cb\ua7dc ÉΣ", "\U00010d50\U00010d51 İ", "\u0378x \U0001fae9 e\u0301 \U0003fffd", "\u1c89 <|endoftext|> Σ\u1c89"]:
        check(own, library, text)
