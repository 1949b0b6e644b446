"""Token files and packing against plain tokenizers and exact round trips."""

from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hedgemark.llm import packing, simple8b
from hedgemark.llm.tokens import BareWords, SpacedBytes, encoder, public_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def plain(name):
    made = Tokenizer.from_file(public_path(name))
    return lambda text, end: np.array([*made.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("kind", "name"), [(BareWords, WORD), (SpacedBytes, BYTE)])
def test_ids_are_those_of_the_tokenizer(odd_docs, sample, kind, name):
    texts = [r.text or "" for r in odd_docs.select("text").union(sample.select("text")).collect()]
    ids = plain(name)
    for text, found in zip(texts, encoder(kind, public_path(name)).encode(texts)):
        assert found == ids(text, 0)[:-1].tobytes()


@pytest.mark.parametrize(("kind", "name"), [(BareWords, WORD), (SpacedBytes, BYTE)])
def test_added_tokens_in_texts(kind, name):
    """Strings of added tokens get the ids that the unmodified tokenizer gives them, wherever they stand."""
    ids = plain(name)
    added = [t.content for t in Tokenizer.from_file(public_path(name)).get_added_tokens_decoder().values()]
    assert added
    texts = [made for a in added for made in (a, f"a {a} b", f"a{a}b", f"{a}{a} x", f"  {a}\n", a.upper(), f"é{a}漢", a[:-1], f"x y {a[1:]}")]
    for text, found in zip(texts, encoder(kind, public_path(name)).encode(texts)):
        assert found == ids(text, 0)[:-1].tobytes(), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint32)
    run = simple8b.encode_run(ids)
    assert (simple8b.decode_run(run["words"], run["escapes"]) == ids).all()


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).zipf(1.4, 30_000).clip(0, 49_000).astype(np.uint32)
    run = simple8b.encode_run(ids)
    assert (simple8b.decode_one_block(**run, block=2) == ids[2 * simple8b.BLOCK_IDS:3 * simple8b.BLOCK_IDS]).all()


def test_token_files_hold_every_id(odd_docs, sample):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    files = simple8b.write_token_files(docs, row_ids=5000)
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r) for r in simple8b.read_token_files(files).collect())
    ids, expected, at = plain(WORD), {}, 0
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append(ids(r.text, 2))
    assert sum(map(len, expected.values())) == len(found)
    for _, r in found:
        assert r.start == at
        at += r.n_tokens
    got = {}
    for _, r in found:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for doc_id, runs in expected.items():
        assert sorted(got[doc_id]) == sorted((len(x), crc32(x.tobytes())) for x in runs)


def test_no_documents(empty_docs):
    assert simple8b.read_token_files(simple8b.write_token_files(empty_docs)).count() == 0
    assert packing.pack_documents(empty_docs).count() == 0


def test_every_id_is_packed_once(odd_docs, sample):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    rows = packing.pack_documents(docs, group_windows=8).collect()
    ids, expected = plain(BYTE), {}
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append(ids(r.text, 1))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for x in expected[r.doc_id])
    total = sum(len(x) for runs in expected.values() for x in runs)
    assert sum(r.length for r in rows) == total
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.CAPACITY * len(used) < 1.05 * total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=200))
def test_windows_are_near_equal_and_never_too_full(sizes):
    sizes = np.array(sizes)
    windows = packing.pack_sizes(sizes, 512)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert max(sizes[w].sum() for w in windows) <= 512


def test_differencing_on_a_known_case():
    # 8, 7, 6, 5, 4 into two: the method ends with a difference of 2
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference(np.array([8, 7, 6, 5, 4]), 2))
    assert sums == [14, 16]


@given(st.integers(0, 20_000))
def test_cuts(n):
    bounds = packing.cuts(n, 2048)
    assert bounds[0] == 0 and bounds[-1] == n and (n == 0 or all(0 < b - a <= 2048 for a, b in zip(bounds, bounds[1:])))
