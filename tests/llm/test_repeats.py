"""Removal of repeated passages against counting all windows."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hedgemark.llm import repeats
from hedgemark.llm.catalog import op13_substring_dedup
from tests.compare import database, difference


def plain(texts, window=35):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def rows_of(spark, texts, **how):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, key int, hits string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df.repartition(3), **how).collect()}
    return [got[k] for k in range(len(texts))]


@pytest.mark.parametrize("period", range(1, 36))
def test_cover(period):
    """Whatever the distance of two places, some offset brings both to a cover position."""
    cover = repeats.difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


def test_cover_is_small():
    assert [len(repeats.difference_cover(p)) for p in (7, 13, 21, 31)] == [3, 4, 5, 6]


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for r, (n, gone, t) in zip(rows, plain([r.text for r in rows]))}
    got = op13_substring_dedup(spark, sf)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    state, n, diff = difference(spark, database(sf), sf, "op13", op13_substring_dedup, entry.oracle_sql()["op13_substring_dedup"])
    assert state == "ok" and n == len(rows), diff


def passages(seed, window):
    """Passages around the window's length at all offsets and distances, in texts of random words."""
    pick = random.Random(seed)
    fresh = iter(range(10 ** 9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    shared = [new(n) for n in (window - 1, window, window + 1, window + 20, 3 * window, 1)]
    texts = []
    for _ in range(40):
        parts = new(pick.randrange(0, 30))
        for _ in range(pick.randrange(0, 4)):
            parts += pick.choice(shared) + new(pick.choice([0, 1, 2, 40]))
        texts.append(pick.choice([" ", "\n", "\t \r"]).join(parts))
    return texts


@pytest.mark.parametrize("seed, window, period", [(1, 35, 21), (2, 35, 21), (3, 35, 21), (4, 10, 7), (5, 10, 10), (6, 5, 1), (7, 1, 1)])
def test_passages(spark, seed, window, period):
    texts = passages(seed, window)
    assert rows_of(spark, texts, window=window, period=period) == plain(texts, window)


def test_overlaps_and_copies(spark):
    words = [f"x{k}" for k in range(90)]
    texts = ["a " * 36, "b " * 35, "b " * 34, "c d " * 30, " ".join(words), " ".join(words), " ".join(words[:60] + ["y"] + words[60:]),
             " ".join(words[20:54]), " ".join(words[20:55]), " ".join(words[:40] + words[:40]), " ".join(words).upper()]
    assert rows_of(spark, texts) == plain(texts)


def test_odd_texts(spark, odd_docs, empty_docs):
    rows = odd_docs.collect()
    got = Counter(tuple(r) for r in repeats.remove_repeats(odd_docs, ["doc_id", "row"]).collect())
    assert got == Counter((r.doc_id, r.row, *p) for r, p in zip(rows, plain([r.text for r in rows])))
    assert repeats.remove_repeats(empty_docs).collect() == []
    nulls = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert {tuple(r)[1:] for r in repeats.remove_repeats(nulls).collect()} == {(0, 0, "")}


def test_other_text_of_the_same_key():
    """A find that is no window of a text by its hash takes nothing out of it."""
    block = next(repeats._blocks(pa.RecordBatch.from_pydict({"text": [" ".join(map(str, range(50)))]})))
    assert repeats._staying(block, np.array([12345, 7]), np.ones(1, bool), 35).all()


def test_words_of_blocks(monkeypatch):
    """Words and hashes do not depend on the block or the place in it; different words have different hashes."""
    texts = ["a b", None, "", " b\ta ", "b", "ab", "b a", "\u00a0 \u3000x\x1cy a", "a" * 300, "a" * 299, *map(str, range(3000))]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    of_hash, of_word = {}, {}
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(repeats, "BLOCK", size)
        seen = []
        for block in repeats._blocks(batch):
            for row, (a, z) in enumerate(pairwise(block.bounds)):
                words = block.joined(row).split(b" ") if a < z else []
                assert words == (texts[block.first + row] or "").encode().split()
                seen.append(block.first + row)
                for word, h in zip(words, block.hashes[a:z].tolist(), strict=True):
                    assert of_word.setdefault(word, h) == h and of_hash.setdefault(h, word) == word
        assert seen == list(range(len(texts)))


def test_texts_are_shuffled_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    cut = repeats.remove_repeats(docs)
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "Cartesian" not in final and "NestedLoop" not in final


def test_wrong_period(spark):
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), period=36)
