"""Elias-Fano sequences and tries against sorted arrays and dictionaries."""

import tempfile
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hedgemark.llm import eliasfano as ef


@settings(max_examples=200, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 2**40)), max_size=300), st.lists(st.integers(0, 2**41), max_size=50))
def test_sequence(values, others):
    values = np.array(sorted(values), np.uint64)
    made = ef.EliasFano.build(values)
    if len(values):
        assert (made.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array(others, np.uint64)])
    where = {int(v): k for k, v in enumerate(values)}
    assert made.find(asked).tolist() == [where.get(int(v), -1) for v in asked]


def test_codes_round_down():
    counts = np.concatenate([np.arange(3000), np.array([10**6, 10**9, 10**12])])
    codes = ef.quantised(counts)
    assert (ef.least(codes) <= counts).all() and (ef.most(codes) >= counts).all()
    assert (ef.least(codes)[:257] == counts[:257]).all() and (ef.least(codes) >= 0.98 * counts).all()


def grams_of(tokens):
    return Counter(zip(tokens, tokens[1:], tokens[2:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=200))
def test_trie(tokens):
    grams = grams_of(tokens)
    keys = sorted(grams, key=lambda g: (g[1], g[0], g[2]))
    arrays = np.array(keys, np.uint32).reshape(-1, 3)
    trie = ef.Trie.build(arrays[:, 1], arrays[:, 0], arrays[:, 2], np.array([grams[k] for k in keys], np.int64), 12)
    with tempfile.TemporaryFile() as file:
        trie.write(file)
        mapped = ef.Trie.mapped(file)
        asked = np.array([(a, b, c) for a in range(10) for b in range(10) for c in range(10)], np.uint32)
        two, three = mapped.find(asked[:, 1], asked[:, 0], asked[:, 2])
        beyond = mapped.find(asked[:, 1], asked[:, 0] + np.uint32(12), asked[:, 2])
        assert (beyond[0] == two).all() and not beyond[1].any()
    pairs = Counter()
    for (_, b, c), n in grams.items():
        pairs[b, c] += n
    assert ef.least(two).tolist() == [pairs[b, c] for _, b, c in asked.tolist()]
    assert ef.least(three).tolist() == [grams[a, b, c] for a, b, c in asked.tolist()]
