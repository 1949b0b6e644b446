"""SimHash groups against a plain pairwise version."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from hedgemark.llm import simhash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_parts(fps, distance):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_like_pairwise(odd_docs, sample):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    parts = plain_parts({f for _, f in rows}, 4)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[parts[f]] = min(doc_id, least.get(parts[f], doc_id))
    expected = sorted(((d, f"{f:016x}", least[parts[f]]) for d, f in rows), key=str)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of("fp"), "component_id").collect()
    assert sorted(map(tuple, found), key=str) == expected


@pytest.mark.parametrize("limit", [20_000, 12])
def test_no_link_is_lost_in_crowded_buckets(spark, limit):
    rng = random.Random(3)
    centre, fps = rng.getrandbits(64), {0, 1, (1 << 64) - 1}
    for _ in range(150):  # a crowd about one centre, at distances around the limit
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 9]))))
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    links = simhash.links_between(nodes, 4, bucket_limit=limit)
    assert links.count() < 30 * len(fps) * (1 if limit > 100 else 40)
    found = {r.fp: r.root for r in simhash.components(nodes, links).collect()}
    parts = plain_parts({f % (1 << 64) for f in found}, 4)
    groups, expected = {}, {}
    for f, root in found.items():
        groups.setdefault(root, set()).add(f % (1 << 64))
        expected.setdefault(parts[f % (1 << 64)], set()).add(f % (1 << 64))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_long_chain_is_one_part(spark):
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] | 1 << k)
    nodes = spark.createDataFrame([(f,) for f in chain], "fp long")
    links = nodes.select("fp").join(nodes.select(F.col("fp").alias("b")), F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) == 1)
    found = simhash.components(nodes, links.select(F.col("fp").alias("a"), "b"))
    assert {r.root for r in found.collect()} == {0}


def test_one_row_of_each_group_stays(odd_docs, sample):
    docs = odd_docs.unionByName(sample, allowMissingColumns=True)
    parts = plain_parts({plain_fingerprint(r.text) for r in docs.collect()}, 4)
    kept = simhash.keep_one(docs).collect()
    assert simhash.keep_one(docs).columns == docs.columns
    assert sorted(parts[plain_fingerprint(r.text)] for r in kept) == sorted(set(parts.values()))


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "x y z w v"), (7, "q r s t u")],
                                 "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == ["a b c d e", "q r s t u", "x y z w v"]
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None, 7}


def test_no_documents(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0
    assert simhash.keep_one(empty_docs).count() == 0
