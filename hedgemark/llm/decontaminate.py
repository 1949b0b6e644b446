"""Benchmark decontamination with built-in functions only.

The windows of all benchmark items form a hash set that travels with the plan while it
is small (it is counted first). Each document row is scanned where it lies: its word
windows are probed against the set, and only positions that pass are looked up, by
their exact text, in the window table. Texts are not shuffled; a clean document moves
its id and word count. A benchmark too large for a set skips the probe and the look-up
becomes a shuffle join over all windows; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import lower_ascii, split_words
from hedgemark.sources.tables import stage

#: What lies between the words of this operator, once A-Z is lower case.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Most windows (8 bytes each in the set, about 100 in the table) that are sent to every task.
SET_LIMIT = 50_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), BREAKS)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``length``, ``window_text``, and the ``item_ids`` that hold it.

    An item of fewer words than a window is one window; an item without words has none.
    A null item id is the id "null"; repeated items count once.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                             words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    found = items.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.least(F.size("w"), F.lit(window)).alias("length"),
        F.concat_ws(" ", F.slice("w", F.col("at"), F.lit(window))).alias("window_text"))
    return found.groupBy("length", "window_text").agg(F.collect_set("item_id").alias("item_ids"))


def _windows_in(length: int, known: list[int] | None) -> Column:
    """Windows of ``length`` of a row (``__w`` words, ``__h`` their hashes) that are in the set, or all without a set."""
    starts = F.when(F.size("__h") >= length, F.sequence(F.lit(1), F.size("__h") - length + 1)) \
        .otherwise(F.array().cast("array<int>"))
    if known is not None:
        starts = F.filter(starts, lambda at: F.xxhash64(F.slice("__h", at, F.lit(length))).isin(known))
    return F.transform(starts, lambda at: F.struct(
        at.alias("at"), F.lit(length).alias("length"),
        F.concat_ws(" ", F.slice("__w", at, F.lit(length))).alias("window_text")))


def _candidates(keys: dict[int, list[int] | None]) -> Column:
    none = F.array().cast("array<struct<at:int,length:int,window_text:string>>")
    return F.concat(none, *[_windows_in(length, known) for length, known in sorted(keys.items())])


class Benchmark:
    """The staged window table of a benchmark and, while it is small, the hash set to probe first."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, set_limit: int = SET_LIMIT):
        self.windows = stage(benchmark_windows(benchmark, window), "windows")
        counts = {r["length"]: r["n"] for r in self.windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
        self.small = sum(counts.values()) <= set_limit
        self.keys: dict[int, list[int] | None] = dict.fromkeys(counts)
        if self.small:
            hashed = self.windows.select("length", F.xxhash64(F.transform(
                F.split("window_text", " "), lambda w: F.xxhash64(w))).alias("key")).collect()
            self.keys = {n: sorted({r["key"] for r in hashed if r["length"] == n}) for n in counts}

    def probe(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``__row``, ``__n_words`` and ``__found``, the candidate windows.

        A filter on ``__found`` must name ``__row`` as well (see ``_with_candidates``): the planner then
        cannot copy the costly columns into the filter, where they would be worked out for each word.
        """
        words = docs.withColumn("__w", words_of(F.col("text")))
        hashed = words.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
        return hashed.select(*docs.columns, F.monotonically_increasing_id().alias("__row"), F.size("__w").cast("long").alias("__n_words"),
                             _candidates(self.keys).alias("__found"))


def _with_candidates(probed: DataFrame, any_: bool) -> DataFrame:
    found = F.size("__found") > 0
    return probed.where((F.col("__row") >= 0) & (found if any_ else ~found))


def judge(docs: DataFrame, benchmark: Benchmark, keep: list[str]) -> DataFrame:
    """One row per document row: columns ``keep``, then ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` and ``hits`` (structs of one-based word position and length, distinct, sorted).

    Null and empty texts have no words and no hits. Repeated rows and equal or null ids are
    judged each for itself. An empty benchmark hits nothing. Columns of ``docs`` that are
    neither ``text`` nor in ``keep`` are dropped first, so their names cannot clash.
    """
    slim = docs.select(F.struct(*keep).alias("doc"), "text")
    rows = benchmark.probe(slim).select(F.col("__row").alias("row"), "doc", "__n_words",
                                        F.explode_outer("__found").alias("hit"))
    # rows without a candidate get a key of their own: no window begins with a space, and none piles up on null
    rows = rows.select("row", "doc", "__n_words", F.struct("hit.at", "hit.length").alias("hit"),
                       F.coalesce("hit.window_text", F.concat(F.lit(" "), F.col("row"))).alias("window_text"))
    windows = benchmark.windows.select("window_text", "item_ids")
    rows = rows.join(F.broadcast(windows) if benchmark.small else windows, "window_text", "left")
    each = rows.groupBy("row").agg(
        F.first("doc").alias("doc"), F.first("__n_words").alias("n_words"),
        F.collect_set(F.when(F.col("item_ids").isNotNull(), F.col("hit"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    words = F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))
    return each.select(
        "doc.*", "n_words", F.size(F.array_distinct(words)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.sort_array("hits").alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: Benchmark, max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose hit words are at most ``max_share`` of their words; columns and rows stay as they were.

    Rows without a candidate window pass by without a shuffle; only the few others are looked up.
    """
    probed = benchmark.probe(docs)
    clean = _with_candidates(probed, False).select(*docs.columns)
    names = list(docs.columns)
    suspects = stage(_with_candidates(probed, True).select(F.struct(*names).alias("whole"), "text"), "suspects")
    judged = judge(suspects, benchmark, ["whole"])
    kept = judged.where(F.col("n_hit") <= F.lit(max_share) * F.col("n_words")).select("whole.*")
    return clean.unionByName(kept)


def remove_spans(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """``docs`` with the hit words taken out of the texts that have any; such a text becomes its other words,
    lower-cased and joined by spaces. All other texts stay as they are."""
    names = list(docs.columns)
    probed = benchmark.probe(docs)
    clean = _with_candidates(probed, False).select(*names)
    suspects = stage(_with_candidates(probed, True).select(F.struct(*names).alias("whole"), "text"), "suspects")
    judged = judge(suspects, benchmark, ["whole"]).withColumn("w", words_of(F.col("whole.text")))
    hit = F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))
    judged = judged.withColumn("hit_words", F.array_distinct(hit))
    rest = F.filter("w", lambda w, i: ~F.array_contains("hit_words", i + 1))
    text = F.when(F.col("contaminated"), F.concat_ws(" ", rest)).otherwise(F.col("whole.text"))
    cut = judged.select(*[text.alias("text") if c == "text" else F.col("whole")[c].alias(c) for c in names])
    return clean.unionByName(cut)
