"""Language identification with bit-sliced Bloom filters over character n-grams.

Fitting counts the n-grams of a bounded number of labelled texts per language, whole
texts, and says for each n-gram which languages hold it at a notable rate. The filter is
one array of bit masks, a bit for each language: an n-gram's masks at its hash places,
and-ed, are all languages that contain it, found in one look-up whatever their number. A
text is judged by its n-grams: each language's count of hits, less the false positives
its filter is expected to give; the largest count decides, ties by the language's name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, code_points, sums_between, text_blocks
from hedgemark.operators.joins import fits_broadcast
from hedgemark.sources.tables import stage

UNKNOWN = "und"
#: Languages of one mask word, and most of all: each word of 64 takes eight bytes a place in every task.
WORD, MOST = 64, 4096
HASHES = 1 << 31


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled texts per language that are learned from (those of smallest hash of id and text).
    ``share``: a language holds an n-gram if its rate there is at least this part of the rates of all.
    ``least``: and if it occurs so often in its sample. ``places``: size of the filter; ``hashes``: places per n-gram."""

    sizes: tuple[int, ...] = (1, 2, 3)
    sample: int = 2000
    share: float = 0.3
    least: int = 3
    places: int = 1 << 20
    hashes: int = 2


def _mixed(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` code points."""
    n = len(points) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size):
        out ^= points[k:k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _normal(texts: list[str]) -> list[str]:
    """Lower case, everything but letters and marks as single spaces, a space at either end; nothing if there is no letter."""
    out = []
    for text in texts:
        if text.isascii():
            kept = text.lower().translate(_ASCII)
        else:
            kept = "".join(map(_letters.__getitem__, text.lower()))
        words = " ".join(kept.split())
        out.append(f" {words} " if any(map(str.isalpha, words)) else "")
    return out


class _Letters(dict):
    def __missing__(self, c: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[c] = found = c if unicodedata.category(c)[0] in "LM" else " "
        return found


_letters = _Letters()
_ASCII = {k: " " for k in range(128) if not chr(k).isalpha()}


def grams(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams inside the texts, in text order, and where each text's begin and the last end.

    Single characters leave out spaces; longer n-grams keep the spaces around words.
    """
    points, bounds = code_points(_normal(texts))
    points = points.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for size in sizes:
        hashes = _mixed(points, size)
        n = len(hashes)
        own = owner[:n] == owner[size - 1:size - 1 + n]
        if size == 1:
            own &= points != 32
        yield hashes[own], np.searchsorted(owner[:n][own], np.arange(len(texts) + 1))


def _places(hashes: np.ndarray, settings: Settings) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(settings.places)).astype(np.int64) for k in range(settings.hashes)]


def _counted(frames: Iterator[pd.DataFrame], sizes: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, part in frame.groupby("lang"):
            for _, texts in text_blocks(part["text"].tolist()):
                for hashes, _ in grams(texts, sizes):
                    found, n = np.unique(hashes, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": found.view(np.int64), "n": n})


@dataclass
class Filters:
    """Masks by place (of the first 64 languages, and ``further`` ones), and the learned languages in order of their bits."""

    langs: list[str]
    masks: np.ndarray
    settings: Settings
    further: tuple[np.ndarray, ...] = ()

    def _bits(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """For each mask word its masks, and the first and the end of its languages."""
        for k, masks in enumerate((self.masks, *self.further)):
            yield masks, k * WORD, min((k + 1) * WORD, len(self.langs))

    def rates(self) -> np.ndarray:
        """Each language's expected rate of false positives."""
        filled = [float(((masks >> np.uint64(b)) & np.uint64(1)).mean()) for masks, a, z in self._bits() for b in range(z - a)]
        return np.array(filled) ** self.settings.hashes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        rates = self.rates()
        for first, run in text_blocks(texts):
            n, hits = np.zeros(len(run), np.int64), np.zeros((len(self.langs), len(run)), np.int64)
            for hashes, bounds in grams(run, self.settings.sizes):
                places = _places(hashes, self.settings)
                n += np.diff(bounds)
                for masks, a, z in self._bits():
                    mask = np.full(len(hashes), ~np.uint64(0))
                    for place in places:
                        mask &= masks[place]
                    for bit in range(z - a):
                        hits[a + bit] += sums_between((mask >> np.uint64(bit)) & np.uint64(1), bounds)
            # of n look-ups, those that miss still hit by chance at the filter's rate
            held = np.clip((hits - rates[:, None] * n) / (1 - np.minimum(rates, 0.99))[:, None], 0, None)
            best = held.argmax(0)
            for k in np.flatnonzero(n):
                names[first + k] = self.langs[best[k]]
                scores[first + k] = float(min(1.0, held[best[k], k] / n[k]))
        return names, scores


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Filters:
    """Learn from ``doc_id, text, lang``; rows without a language or text teach nothing.

    The texts are a bounded sample per language, so the n-gram table that reaches the
    driver is bounded too: it comes as one row per occupied place of the filter, at most
    ``places`` for each 64 languages. Rows are chosen by a hash of id and text, so null and
    equal ids are rows like any other; rows repeated in both count once. An empty table
    teaches nothing. Other columns are not read, so their names cannot clash.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    keys = labelled.select("lang", "key", F.pmod("key", F.lit(HASHES)).alias("h"))
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("key").alias("rows")).limit(MOST + 1).collect()
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    langs = sorted(r["lang"] for r in sizes)
    # of a large language only about twice the sample is ranked, chosen by the hash
    below = [(r["lang"], min(HASHES, 2 * settings.sample * HASHES // max(r["rows"], 1) + 1)) for r in sizes]
    keys = keys.join(F.broadcast(spark.createDataFrame(below, "lang string, below long")), "lang") \
        .where(F.col("h") < F.col("below")).select("lang", "key", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    chosen = stage(keys.withColumn("rank", rank).where(F.col("rank") <= settings.sample), "sample").select("lang", "key")
    chosen = F.broadcast(chosen) if fits_broadcast(chosen) else chosen
    sample = labelled.join(chosen, ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.first("text").alias("text"))
    counts = stage(sample.mapInPandas(lambda frames: _counted(frames, settings.sizes), "lang string, gram bigint, n bigint")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    overall = rates.groupBy("gram").agg(F.sum("rate").alias("rates"))
    bits = spark.createDataFrame(list(enumerate(langs)), "bit int, lang string")
    held = rates.join(overall, "gram").where(
        (F.col("rate") >= settings.share * F.col("rates")) & (F.col("n") >= settings.least)).join(F.broadcast(bits), "lang")
    by_gram = held.groupBy("gram", F.floor(F.col("bit") / WORD).cast("int").alias("word")) \
        .agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {WORD})")).alias("mask"))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place in _places(frame["gram"].to_numpy().view(np.uint64), settings):
                yield pd.DataFrame({"place": place, "word": frame["word"], "mask": frame["mask"]})

    rows = by_gram.mapInPandas(placed, "place bigint, word int, mask bigint") \
        .groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((max(1, -(-len(langs) // WORD)), settings.places), np.uint64)
    if len(rows):
        masks[rows["word"].to_numpy(), rows["place"].to_numpy()] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, masks[0], settings, tuple(masks[1:]))


def predicted(text: Column, filters: Filters, spark: SparkSession) -> Column:
    """Struct ``lang_pred, score`` for a text column; "und" with score 0 where there is no letter (or nothing was learned)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((filters.langs, filters.settings, [m.tobytes() for m in (filters.masks, *filters.further)]))

    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, settings, words = shared.value
        masks = [np.frombuffer(w, np.uint64) for w in words]
        own = Filters(langs, masks[0], settings, tuple(masks[1:]))
        for texts in columns:
            names, scores = own.predict([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(judge, "lang_pred string, score double")(text)
