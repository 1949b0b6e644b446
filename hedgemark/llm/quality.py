"""Quality rules whose thresholds adapt to each language and source, with built-in functions only.

One pass works out the measures of each text inside its row (no shuffle of words or
texts) and stages them; mergeable quantile sketches of the measures are then built per
language and source. A group of few rows takes the merged sketch of its language, and
that of few rows the merged sketch of all. The quartiles that follow are joined back. A
fence lies ``reach`` spreads outside them, where the spread is the quartile distance of
the group or, if larger, the noise of a count in a text of that length; no cutoff is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.llm.common import split_words
from hedgemark.operators.joins import spread_join
from hedgemark.sources.tables import stage

SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Base rule: at least so many words, and at most so many per cent of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: share -> (counted, out of, how many one event adds): a window found twice covers six words
SHARES = {
    "symbol_share": ("n_symbols", "n_words", 1.0),
    "dup_line_share": ("n_dup_lines", "n_lines", 1.0),
    "repeat_share": ("n_repeat_words", "n_words", 6.0),
}
MEASURES = ("word_length", *SHARES)


@dataclass(frozen=True)
class Rules:
    """Fences lie ``reach`` spreads outside the quartiles; a group below ``min_rows`` uses a wider one.

    Sketches tell values apart that differ by ``accuracy`` of themselves.
    """

    reach: float = 5.0
    min_rows: int = 200
    accuracy: float = 0.002


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (other columns are dropped first), then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("doc"), text.alias("text"))
    rows = rows.select(
        "doc", F.length(_without(F.col("text"), SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.length(_without(line, SPACE_CHARS)) > 0).alias("lines"),
        F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    rest2 = F.slice("h", 2, F.greatest(F.size("h"), F.lit(1)))
    rest3 = F.slice("h", 3, F.greatest(F.size("h"), F.lit(1)))
    windows = F.zip_with(F.zip_with("h", rest2, lambda a, b: F.xxhash64(a, b)), rest3, lambda a, b: F.xxhash64(a, b))
    rows = rows.select(
        "doc", "word_chars", "n_symbols", F.size("h").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(windows, 1, F.greatest(F.size("h") - 2, F.lit(0))).alias("v"))
    # most texts repeat no window, which one pass over the hashes shows; only the others sort theirs
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("v")) == F.size("v"), none).otherwise(
        F.sort_array(F.transform("v", lambda key, at: F.struct(key.alias("key"), at.alias("at"))))))
    rows = rows.withColumn("same", F.zip_with(
        F.col("sorted.key"), F.slice(F.col("sorted.key"), 2, F.greatest(F.size("sorted"), F.lit(1))),
        lambda a, b: F.coalesce(a == b, F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.slice("same", 1, F.greatest(F.size("same") - 1, F.lit(0))))
    rows = rows.withColumn("at", F.array_sort(F.filter(
        F.zip_with(F.col("sorted.at"), F.zip_with("same", before, lambda a, b: a | b),
                   lambda at, hit: F.when(hit, at)), lambda at: at.isNotNull())))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))),
                      lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    repeated = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return rows.select("doc.*", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       repeated.cast("long").alias("n_repeat_words"), "n_lines")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _scaled(rows: DataFrame) -> DataFrame:
    """Adds each measure on a scale where its noise does not depend on its size, and that noise (``noise_<measure>``).

    Shares become square roots (Anscombe's transform of a count): their noise follows the
    length alone, and most texts having none does not make the quartiles coincide. The
    noise of a mean word length is that of a Poisson length.
    """
    over = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = {"base_failed": _base_failed(), "word_length": F.col("word_chars") / over,
            "noise_word_length": F.sqrt(F.col("word_chars")) / over}
    for share, (count, total, unit) in SHARES.items():
        out_of = F.col(total) / F.lit(unit) + F.lit(0.75)
        made[share] = F.sqrt((F.col(count) / F.lit(unit) + F.lit(0.375)) / out_of)
        made[f"noise_{share}"] = F.lit(0.5) / F.sqrt(out_of)
    return rows.withColumns(made)


def sketches(rows: DataFrame, rules: Rules) -> DataFrame:
    """Logarithmic buckets of each measure per language and source: g_lang, g_source, measure, bucket, n.

    A quantile sketch with a relative error of half ``accuracy`` that merges by adding up,
    so it does not depend on the order or number of tasks. Combined before the shuffle;
    a group has at most a few thousand buckets a measure, and no more than rows.
    """
    step = math.log1p(rules.accuracy)
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.log(F.col(m)) / F.lit(step)).alias("bucket"))
                       for m in MEASURES])
    fit = rows.where(~F.col("base_failed")).select("g_lang", "g_source", F.explode(values).alias("v"))
    return fit.groupBy("g_lang", "g_source", "v.measure", "v.bucket").agg(F.count("*").alias("n"))


def _quartiles(cells: DataFrame, keys: list[str], rules: Rules, name: str) -> DataFrame:
    """Per ``keys``: struct ``name`` of n and, for each measure, its quartiles q1_ and q3_."""
    step = math.log1p(rules.accuracy)
    merged = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    merged = merged.withColumns({"upto": F.sum("n").over(whole.orderBy("bucket")), "total": F.sum("n").over(whole)})
    value = F.exp((F.col("bucket") + F.lit(0.5)) * F.lit(step))
    found = [F.max("total").alias("n")]
    for m in MEASURES:
        for q, part in (("q1", 0.25), ("q3", 0.75)):
            reached = (F.col("measure") == m) & (F.col("upto") >= F.lit(part) * F.col("total"))
            found.append(F.min(F.when(reached, value)).alias(f"{q}_{m}"))
    made = merged.groupBy(*keys).agg(*found)
    return made.select(*keys, F.struct(*[c for c in made.columns if c not in keys]).alias(name))


def fences(rows: DataFrame, rules: Rules) -> DataFrame:
    """Quartiles ``q1_<measure>``, ``q3_<measure>`` that hold for each ``g_lang`` and ``g_source``.

    One row per pair of values that occurs, so its size follows the sources, not the texts.
    """
    cells = stage(sketches(rows, rules).withColumn("g_all", F.lit(0)), "sketches")
    pairs = rows.groupBy("g_lang", "g_source").agg(F.first("g_all").alias("g_all"))
    found = pairs.join(_quartiles(cells, ["g_lang", "g_source"], rules, "own"), ["g_lang", "g_source"], "left") \
        .join(_quartiles(cells, ["g_lang"], rules, "lang"), "g_lang", "left") \
        .join(_quartiles(cells, ["g_all"], rules, "total"), "g_all", "left")
    used = F.when(F.col("own.n") >= rules.min_rows, F.col("own")) \
        .when(F.col("lang.n") >= rules.min_rows, F.col("lang")).otherwise(F.col("total"))
    return found.select("g_lang", "g_source", used.alias("s")).select(
        "g_lang", "g_source", *[f"s.{q}_{m}" for m in MEASURES for q in ("q1", "q3")])


def _pair() -> Column:
    return F.to_json(F.struct("g_lang", "g_source"))


def judge(docs: DataFrame, keep: list[str], rules: Rules = Rules()) -> DataFrame:
    """One row per document row: ``keep``, the measures, ``base_failed``, ``kept``, and ``reasons``.

    ``docs`` needs text, lang and source; columns not in ``keep`` are dropped, so their
    names cannot clash. A null text has no words and fails the base rule. A null language
    or source is a group of its own. Equal rows get equal verdicts. Where no row of the
    table passes the base rule there are no fences and the base rule alone decides.
    """
    groups = docs.select(F.struct(*keep).alias("doc"), "text", F.to_json(F.struct("lang")).alias("g_lang"),
                         F.to_json(F.struct("source")).alias("g_source"))
    rows = stage(_scaled(measured(groups, ["doc", "g_lang", "g_source"])).withColumn("g_all", F.lit(0)), "measures")
    limits = fences(rows, rules).withColumn("g_pair", _pair()).drop("g_lang", "g_source")
    joined = spread_join(rows.withColumn("g_pair", _pair()), limits, "g_pair", "left", tie=["doc", "n_words", "word_chars"])
    reasons = [F.when(F.col("base_failed"), F.lit("base"))]
    for m in MEASURES:
        q1, q3 = F.col(f"q1_{m}"), F.col(f"q3_{m}")
        reach = F.lit(rules.reach) * F.greatest(q3 - q1, F.col(f"noise_{m}"))
        out = F.col(m) > q3 + reach
        if m not in SHARES:
            out = out | (F.col(m) < q1 - reach)
        reasons.append(F.when(out, F.lit(m)))
    joined = joined.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return joined.select("doc.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (F.size("reasons") == 0).alias("kept"), "reasons")
