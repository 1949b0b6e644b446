"""Token counts against the tokenizer library's own unigram model."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from hedgemark.llm import counts
from hedgemark.llm.tokens import public_path


def plain(vocabulary):
    # the library begins with an unknown piece; bytes are pieces of their own
    pieces = [("<unk>", min(s for _, s in vocabulary)), *vocabulary, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    return Tokenizer(models.Unigram(pieces, 0, True)), [(p, s) for p, s in pieces if p != "<unk>"]


VOCABULARY = [("▁", -3.0), ("▁a", -2.0), ("a", -1.0), ("aa", -2.0), ("ab", -2.5), ("b", -1.5), ("ba", -2.5), ("aba", -3.5),
              ("▁ab", -3.5), ("bb", -3.0), ("é", -2.0)]


@settings(max_examples=300, deadline=None)
@given(st.text("abécx漢", max_size=30))
def test_ties_and_unknown_characters(word):
    library, pieces = plain(VOCABULARY)
    assert counts.Counter(pieces)[word][0] == len(library.encode("▁" + word).ids)


@pytest.fixture(scope="module")
def full():
    pieces = counts.pieces_of(public_path("piece_bpe_32k.model"))
    unknown = next(k for k, (p, _) in enumerate(pieces) if p == "<unk>")
    return Tokenizer(models.Unigram(pieces, unknown, True))


def test_like_the_library_on_texts(odd_docs, sample, full):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    expected = []
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        expected.append((r.doc_id, len(words), sum(len(full.encode("▁" + w).ids) for w in words)))
    found = counts.token_counts(docs, ["doc_id"]).drop("score").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_no_documents_and_no_vocabulary(empty_docs):
    assert counts.token_counts(empty_docs, ["doc_id"]).count() == 0
    assert counts.Counter([])["ab"][0] == 5
