"""Language-model scores against dictionaries of counts."""

import re
from collections import Counter
from math import log10
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from hedgemark.llm import lm
from hedgemark.llm.common import LOWER, UPPER, crc_fold


def plain(rows, m2, m3):
    """Scores by the formulas, counts exact."""
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(UPPER, LOWER))), None] for _, t, _ in rows]
    one, two, three, after_one, after_two = Counter(), Counter(), Counter(), Counter(), Counter()
    for (_, _, held), words in zip(rows, texts):
        if not held:
            padded = [0, 0, *words]
            for u, v, w in zip(padded, padded[1:], words):
                one[w] += 1
                two[v, w] += 1
                three[u, v, w] += 1
                after_one[v] += 1
                after_two[u, v] += 1
    n, v1 = sum(one.values()), len(one)
    out = []
    for (doc_id, _, held), words in zip(rows, texts):
        base = score = 0.0
        padded = [0, 0, *words]
        for u, v, w in zip(padded, padded[1:], words):
            p1 = (one[w] + 0.5) / (n + 0.5 * (v1 + 1))
            p2 = (two[v, w] + m2 * p1) / (after_one[v] + m2)
            p3 = (three[u, v, w] + m3 * p2) / (after_two[u, v] + m3)
            base, score = base + log10(p1), score + log10(p3)
        out.append((doc_id, held, len(words), sum(one[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize("settings", [lm.Settings(), lm.Settings(chunk_tokens=3000, shard_tokens=1000)])
def test_like_plain_counts(odd_docs, sample, settings):
    docs = odd_docs.select("doc_id", "text").unionByName(sample.select("doc_id", "text"))
    docs = docs.withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 1).withColumn("chunk", F.lit(1))
    rows = [(r.doc_id, r.text, crc32(str(r.doc_id or "" if r.doc_id is None else r.doc_id).encode()) % 5 == 1)
            for r in docs.collect()]
    found = sorted(map(tuple, lm.score_documents(docs, settings).collect()), key=str)
    expected = sorted(plain(rows, settings.m2, settings.m3), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-3)


def test_the_model_adds_up_to_one(spark):
    texts = ["a b a b c", "a b", "c c a", None, "b"]
    learn = [(k, t, False) for k, t in enumerate(texts)]
    ask = [(100 + k, f"{w}", True) for k, w in enumerate(["a", "b", "c", "", "zz"])]
    rows = lm.score_documents(spark.createDataFrame(learn + ask, "doc_id long, text string, held_out boolean")).collect()
    # the first word after the beginning: each asked text is that word and the end after it
    score = {r.doc_id: r.score for r in rows}
    counts = plain(learn + ask, lm.Settings().m2, lm.Settings().m3)
    for r in counts:
        assert score[r[0]] == pytest.approx(r[6], rel=1e-9)


def test_nothing_to_learn_and_no_documents(spark, empty_docs):
    rows = lm.score_documents(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)]
    assert lm.score_documents(empty_docs.withColumn("held_out", F.lit(False))).count() == 0


def test_held_out_texts_score_better_than_single_words(sample):
    rows = lm.score_documents(sample.withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 1)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
