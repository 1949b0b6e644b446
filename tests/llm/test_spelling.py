"""Spelling variants against nested loops."""

import random
import zlib
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from hedgemark.llm import spelling
from hedgemark.llm.catalog import op12_spelling_variants

LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}


def plain_words(rows, slips=97, least=5, least_n=3):
    counts = Counter()
    for doc_id, text in rows:
        runs, run = [], ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c.lower() if c < "\x80" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(words, ratio=2):
    found = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        found[w] = (n, len(around), form)
    out = set()
    for w, (n, n_near, form) in found.items():
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        out.add((w, n, n_near, form, None if form is None else words[form], root))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got))
    return set(got)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("id", F.lit(1))


def corpus(counts):
    """One document for each number of uses, so that every word has its count."""
    return [(k, " ".join(w for w, n in counts.items() if n > k)) for k in range(max(counts.values(), default=0))]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    got = op12_spelling_variants(spark, sf)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "bigint", "string", "bigint", "string"]
    assert rows_of(got) == plain_variants(words)


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("aé×z", 2)])
def test_crowded_words(spark, letters, seed):
    """Few letters, so that most words have many neighbours, runs of one letter, and chains of forms."""
    pick = random.Random(seed)
    counts = {}
    while len(counts) < 250:
        word = "".join(pick.choice(letters) for _ in range(pick.choice([5, 5, 6, 6, 7, 8, 12])))
        counts[word] = pick.choice([3, 3, 4, 6, 7, 12, 14, 25])
    assert rows_of(spelling.variants(frame(spark, corpus(counts)), slips=0)) == plain_variants(counts)


def test_each_place(spark):
    """Every edit of one word, at every place, with letters before and after it in the alphabet."""
    word, counts = "mnomnp", {"mnomnp": 40}
    for k in range(len(word) + 1):
        for c in "amz":
            counts.setdefault(word[:k] + c + word[k:], 3 + k)
            counts.setdefault(word[:k] + c + word[k + 1:], 4)
        counts.setdefault(word[:k] + word[k + 1:], 5)
    counts["mnomnpqr"] = 9  # begins like a word, two letters on
    assert rows_of(spelling.variants(frame(spark, corpus(counts)), slips=0)) == plain_variants(counts)


def test_chains(spark):
    """Forms of forms: the root is the last word of the chain."""
    chain = ["aaaaa" + "b" * k for k in range(9)]
    counts = {w: 3 * 2 ** k for k, w in enumerate(chain)}
    docs = frame(spark, [(k, f"{w} " * n) for k, (w, n) in enumerate(counts.items())])
    got = spelling.variants(docs, slips=0)
    assert rows_of(got) == plain_variants(counts)
    assert {r.root for r in got.collect()} == {chain[-1]}
    assert all(near(a, b) for a, b in pairwise(chain))


def test_long_words(spark):
    """Words of many letters take no more rounds than they have branchings."""
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(3_000))
    words = [base, base[:7] + base[8:], base[:-1], base + "x", base[:2_000] + "z" + base[2_001:], "z" + base]
    counts = {w: 3 + 4 * k for k, w in enumerate(words)}
    docs = frame(spark, [(k, f"{w} " * n) for k, (w, n) in enumerate(counts.items())])
    got = rows_of(spelling.variants(docs, slips=0))
    assert {(r[0][:20], len(r[0]), r[1], r[2]) for r in got} == {(r[0][:20], len(r[0]), r[1], r[2]) for r in plain_variants(counts)}
    assert got == plain_variants(counts)


def test_odd_texts(spark, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(spelling.variants(odd_docs, least_count=1)) == plain_variants(plain_words(rows, least_n=1))
    assert spelling.variants(empty_docs).collect() == []
    assert spelling.variants(odd_docs.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_slips(spark):
    """Slips follow id and run; null ids count as empty text."""
    rows = [(None if k % 50 == 0 else k, "Straßen ÀÉ×÷ letters Letters lettersx") for k in range(400)]
    assert rows_of(spelling.variants(frame(spark, rows))) == plain_variants(plain_words(rows))


def test_prefix_hashes():
    def each(words):
        values, offsets = spelling.prefix_hashes(words)
        return [values[a:z].tolist() for a, z in pairwise(offsets)]

    words = ["", "a", "ab", "abc", "b", "aé🙂"]
    found = each(words)
    assert [len(f) for f in found] == [1, 2, 3, 4, 2, 4]
    by_prefix = {}
    for word, hashes in zip(words, found):
        for k, h in enumerate(hashes):
            assert by_prefix.setdefault(word[:k], h) == h
    assert len(set(by_prefix.values())) == len(by_prefix)
    assert each(words[::-1]) == found[::-1] and each([]) == []
