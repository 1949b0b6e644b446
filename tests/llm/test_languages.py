"""Language filters: no false negatives, held-out accuracy, odd texts."""

import numpy as np
from pyspark.sql import functions as F

from hedgemark.llm import languages
from hedgemark.llm.common import crc_fold

SMALL = languages.Settings(places=1 << 16)


def fitted(docs):
    return languages.fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2), SMALL)


def test_held_out_accuracy(spark, sample):
    filters = fitted(sample)
    assert filters.langs == sorted({r.lang for r in sample.select("lang").distinct().collect()})
    held = sample.where(crc_fold(F.col("doc_id"), 4) == 2)
    rows = held.select("lang", languages.predicted(F.col("text"), filters, spark).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_every_inserted_gram_is_found(spark):
    docs = spark.createDataFrame([(1, "abc abc abc abc", "x"), (2, "uvw uvw uvw uvw", "y")], "doc_id long, text string, lang string")
    filters = languages.fit(docs, SMALL)
    for bit, text in enumerate(("abc abc abc abc", "uvw uvw uvw uvw")):
        for hashes, _ in languages.grams([text], (1,)):
            mask = np.full(len(hashes), ~np.uint64(0))
            for place in languages._places(hashes, SMALL):
                mask &= filters.masks[place]
            assert (mask >> np.uint64(bit) & np.uint64(1)).all()


def test_hits_like_a_plain_count(sample):
    filters = fitted(sample)
    texts = [r.text for r in sample.limit(30).collect()]
    for text in texts:
        n, hits = 0, [0] * len(filters.langs)
        for size in SMALL.sizes:
            for hashes, _ in languages.grams([text], (size,)):
                for h in hashes:
                    masks = [int(filters.masks[p[0]]) for p in languages._places(np.array([h]), SMALL)]
                    n += 1
                    for bit in range(len(hits)):
                        hits[bit] += all(m >> bit & 1 for m in masks)
        rates = filters.rates()
        held = [max(0, (h - r * n) / (1 - r)) for h, r in zip(hits, rates)]
        names, scores = filters.predict([text])
        assert names[0] == filters.langs[held.index(max(held))]
        assert abs(scores[0] - min(1, max(held) / n)) < 1e-9


def test_odd_texts(spark, odd_docs, sample):
    filters = fitted(sample)
    for r in odd_docs.select("text", languages.predicted(F.col("text"), filters, spark).alias("p")).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p.lang_pred == "und") == (not letters)
        assert r.p.lang_pred in [*filters.langs, "und"]


def test_nothing_to_learn(spark, empty_docs, odd_docs):
    filters = languages.fit(empty_docs)
    assert {r.p.lang_pred for r in odd_docs.select(languages.predicted(F.col("text"), filters, spark).alias("p")).collect()} == {"und"}


def test_rows_without_an_id_teach(spark):
    """Null, equal and repeated ids are rows like any other, and a repeated row counts once."""
    english, french = "hello there friend how are you today number", "bonjour mon ami comment vas tu ce matin"
    rows = [(None, f"{english} {k}", "en") for k in range(50)] + [(k, f"{french} {k}", "fr") for k in range(50)]
    rows += [(7, f"{word} unser guter freund wie geht es dir", "de") for word in ("hallo", "ach", "nun", "so", "ja")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("h", F.lit(1))
    for sample in (2000, 20, 4):
        filters = languages.fit(docs, languages.Settings(places=1 << 16, sample=sample, least=1))
        assert filters.langs == ["de", "en", "fr"]
        assert filters.predict(["hello there friend how are you", "mon ami comment vas tu", "guter freund wie geht es"])[0] == ["en", "fr", "de"]


def test_many_languages(spark):
    """Two hundred languages, each with letters of its own."""
    letters = [chr(0x4E00 + 10 * k) + chr(0x4E05 + 10 * k) for k in range(200)]
    rows = [(k, f"{word} " * 9, f"l{k:03}") for k, word in enumerate(letters)]
    filters = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), SMALL)
    assert len(filters.langs) == 200 and len(filters.further) == 3
    assert filters.predict([word * 2 for word in letters])[0] == [f"l{k:03}" for k in range(200)]
    docs = spark.createDataFrame([(t,) for t in letters], "text string")
    got = docs.select(languages.predicted(F.col("text"), filters, spark).alias("p")).collect()
    assert sorted(r.p.lang_pred for r in got) == filters.langs
