"""Ids equal to the library's on the whole text, and exact round trips."""

import hashlib

import pytest
from footfall.llm import bpe
from hypothesis import given, settings, strategies as st

CODER = bpe.encoding(bpe.RANKS, bpe.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab1é \n\t'sx.😀  ")), max_size=80), st.integers(1, 7))
def test_cutting_changes_nothing(text, size):
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode_text(text, CODER, size) == CODER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert CODER.decode_bytes(bpe.encode_text(text, CODER)) == text.encode()


@pytest.mark.parametrize("text", ["word " * 60_000, "a" * 150_000, "<|endoftext|>", "日本語" * 30_000])
def test_long_and_special(text):
    ids = bpe.encode_text(text, CODER)
    assert ids == CODER.encode_ordinary(text)
    assert CODER.decode_bytes(ids) == text.encode()


def test_tables(documents, clashing):
    docs = clashing(documents("one two", None, "", "one two", (None, "é")))
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for own, text in [(0, "one two"), (1, ""), (2, ""), (3, "one two"), (None, "é")]:
        ids = CODER.encode_ordinary(text)
        want.add((own, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())))
    assert rows == want
    assert bpe.digests(docs.limit(0)).collect() == []


def test_decode(documents):
    tokens = bpe.encode(documents("one é two", None))
    assert sorted((r.id, bytes(r.decoded)) for r in bpe.decode(tokens).collect()) == [(0, "one é two".encode()), (1, b"")]
