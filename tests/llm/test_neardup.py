"""Near copies of the pipeline against plain pairwise Jaccard similarity, and recall on planted pairs."""

import random
import re

import pytest

import corpus_pipeline
from hedgemark.llm import neardup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_least(docs):
    sets = {doc_id: plain_shingles(text) for doc_id, text in docs}
    root, ids = {d: d for d in sets}, sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if alike(sets[a], sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return sorted(set(root.values()))


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"z{rng.getrandbits(40):x}"
    return out


def planted(seed, pairs):
    rng = random.Random(seed)
    made = []
    for _ in range(pairs):
        words = [f"w{rng.randrange(30_000)}" for _ in range(rng.randrange(100, 1500))]
        made.append((" ".join(words), " ".join(edited(words, max(1, round(len(words) * rng.uniform(0.005, 0.024))), rng))))
    return made


def test_edited_copies_go_in_the_stage(spark, sf):
    # 2 % of the words changed: similarity about 0.82, far more than four bits of a fingerprint
    pairs = [(a, b) for a, b in planted(5, 200) if alike(plain_shingles(a), plain_shingles(b))]
    rows = [(2 * k + at, text) for k, pair in enumerate(pairs) for at, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == list(range(0, len(rows), 2))


def test_like_pairwise_on_the_sample(spark, sf, sample):
    kept = corpus_pipeline.near_dedup(spark, sample, sf)
    assert kept.columns == sample.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_least([(r.doc_id, r.text) for r in sample.collect()])


@pytest.mark.parametrize("block_bytes", [neardup.BLOCK_BYTES, 3000])
def test_chains_and_blocks(spark, block_bytes):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    docs = [(0, " ".join(words))]
    for k in range(1, 25):  # a chain: the ends have little in common
        words = edited(words, 3, rng)
        docs.append((k, " ".join(words)))
    docs += [(100 + k, " ".join(edited([f"v{j}" for j in range(150)], 2 + k % 4, rng))) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(frame, block_bytes).collect()) == plain_least(docs)


def test_odd_rows(spark, odd_docs, empty_docs):
    kept = neardup.keep_one(odd_docs)
    sets = [plain_shingles(r.text) for r in odd_docs.collect()]
    assert kept.columns == odd_docs.columns
    assert sorted(map(sorted, (plain_shingles(r.text) for r in kept.collect()))) == sorted(map(sorted, set(sets)))
    assert neardup.keep_one(empty_docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x y z w v"), (7, "q r s t u"), (8, "Q r s t u")],
                                 "doc_id long, text string")
    assert sorted(r.text for r in neardup.keep_one(docs).collect()) == ["a b c d e", "q r s t u", "x y z w v"]
