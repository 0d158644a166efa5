import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks(PATH).ranks, special_tokens={})


def check(theirs, texts):
    ranks = bpe.rank_file(PATH)
    ids, counts = ranks.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == theirs.encode_ordinary(text), text[:80]
        assert ranks.decode(ids[at : at + n]).tobytes() == text.encode()
        at += n
    assert at == len(ids)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), st.text(" \n\t'strevlmdaS1. é日", max_size=40)), max_size=8))
def test_equals_the_library(theirs, texts):
    check(theirs, texts)


def test_long_pieces_and_blocks(theirs):
    texts = ["a" * 5000, "ab" * 3000 + " " + "x" * 700, "'" * 100, " " * 3000 + "x", "It's we'll they've'd 're", "", "".join(map(chr, range(0x20, 0x3000)))]
    check(theirs, texts)
    check(theirs, [" ".join(texts)] * 3)
    piece = b"abcabcabd" * 20
    assert bpe.rank_file(PATH).merged_long(piece) == theirs.encode_ordinary(piece.decode())


def test_query(spark, theirs, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(theirs, odd_docs, no_docs):
    back = bpe.decode(bpe.encode(odd_docs, PATH), PATH)
    want = sorted(((r.doc_id or 0), r.text or "") for r in odd_docs.collect())
    assert sorted(((r.doc_id or 0), bytes(r.bytes).decode()) for r in back.collect()) == want
    assert all(r.ids == theirs.encode_ordinary(bytes(r.bytes).decode()) for r in back.collect())
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
