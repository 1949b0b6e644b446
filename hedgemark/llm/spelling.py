"""Spelling variants by a relational trie frontier.

The words of the corpus form a trie whose edges are a distributed table. States (word, rest
of it, node, edits) are joined with the edges of one level after the other: an exact step
keeps the edits, a replaced or a skipped letter makes them one, and after that only exact
steps are left. A state that ends where a word ends, with one edit, is a pair of neighbours.

Two things keep the frontier thin. An edit lies in the second half of a word or in that of
its reverse, so each of two tries (of words, and of reversed words) is entered in the middle
of the word, where few edges leave a node. And edges are compressed: a node is kept only
where words part or end, so an edge carries several letters and the number of rounds is
that of branchings, not of letters. A replaced letter is followed in one direction and a
missing letter from the longer word only; both pairs are mirrored at the end.

Nodes are told by a hash of their letters. Should two prefixes share one, their edges are
followed together, and the last step, which compares the words themselves, drops what is wrong.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, code_points
from hedgemark.sources.tables import stage

#: Runs of letters in Latin-1, where a code point is a byte and only A-Z is made lower case.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
LEAST_LETTERS, LEAST_COUNT, RATIO, SLIPS = 5, 3, 2, 97
#: Words that a task counts before it hands them on.
MEMORY = 300_000


def _frame(counts: Counter[bytes], least_letters: int) -> pd.DataFrame:
    words = [w for w in counts if len(w) >= least_letters]
    return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in words], dtype=object),
                         "n": pd.Series([counts[w] for w in words], dtype=np.int64)})


def _counted(frames: Iterator[pd.DataFrame], slips: int, least_letters: int) -> Iterator[pd.DataFrame]:
    total, crc = Counter(), zlib.crc32
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            runs = Counter(RUN.findall(text.encode("latin-1", "replace").lower()))  # other characters become "?"
            before = crc(f"{doc_id}:".encode())
            for run, n in runs.items():
                if len(run) >= least_letters:  # a slip only shortens
                    h = crc(run if run.isascii() else run.decode("latin-1").encode("utf-8"), before)
                    if slips and not h % slips:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    total[run] += n
            if len(total) > MEMORY:
                yield _frame(total, least_letters)
                total.clear()
    yield _frame(total, least_letters)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """``word, n, id``: the words of all texts, counted in the tasks before anything is shuffled."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    counts = texts.mapInPandas(lambda frames: _counted(frames, slips, least_letters), "word string, n bigint")
    words = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return stage(words.where(F.col("n") >= least_count).withColumn("id", F.monotonically_increasing_id()), "words")


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit numbers mixed so that every bit depends on every other."""
    x = (x + _MIX) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of all words, the empty ones first, and where those of each word begin; in time linear in the letters."""
    points, bounds = code_points(words)
    sizes = np.diff(bounds)
    offsets = bounds + np.arange(len(bounds))
    place = np.arange(len(points)) - np.repeat(bounds[:-1], sizes)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), _BASE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(points.astype(np.uint64)) * powers[place])])
    depth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes + 1)
    at = np.repeat(bounds[:-1], sizes + 1)
    return _spread((sums[at + depth] - sums[at]) ^ _spread(depth.astype(np.uint64))).view(np.int64), offsets


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = prefix_hashes(batch.column("letters").to_pylist())
        nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("letters"), nodes], ["id", "letters", "nodes"])


def _rest(text: Column, taken: Column) -> Column:
    return F.substring(text, taken + 1, F.length(text))


def _trie(hashed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The compressed trie of words (id, letters, nodes) below the level of their shortest half: its edges, and a first state per word.

    Edges: level, node, label, child, ends (some word ends at the child). States: level, id, rest, node, edits, ends.
    """
    least = LEAST_LETTERS // 2
    each = hashed.select("id", F.posexplode("nodes").alias("depth", "node"), "letters").where(F.col("depth") >= least) \
        .select("id", "depth", "node", F.substring("letters", F.col("depth") + 1, F.lit(1)).alias("next"))
    # kept are the nodes where words part, or where one ends (there the next letter is empty)
    kept = each.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")) \
        .where((F.col("low") != F.col("high")) | (F.col("low") == "")).select("node", (F.col("low") == "").alias("ends"))
    paths = each.join(kept.hint("merge"), "node").groupBy("id") \
        .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "ends"))).alias("path")).join(
            hashed.select("id", "letters").hint("merge"), "id")
    paths = stage(paths, f"{name}-paths")
    # the last kept node of the first half, or else the first of all: no word parts from this one before it
    half = F.floor(F.length("letters") / 2)
    level = F.greatest(F.size(F.filter("path", lambda p: p["depth"] <= half)) - 1, F.lit(0))
    states = paths.select("id", "letters", "path", level.alias("level")).withColumn("at", F.get("path", "level")).select(
        "level", "id", _rest(F.col("letters"), F.col("at.depth")).alias("rest"), F.col("at.node").alias("node"),
        F.lit(0).alias("edits"), F.col("at.ends").alias("ends"))
    steps = paths.select("letters", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("level")) \
        .select("letters", "level", F.get("path", "level").alias("from"), F.get("path", F.col("level") + 1).alias("to")) \
        .where("to IS NOT NULL")
    edges = steps.select("level", F.col("from.node").alias("node"), F.col("to.node").alias("child"), F.col("to.ends").alias("ends"),
                         F.substring("letters", F.col("from.depth") + 1, F.col("to.depth") - F.col("from.depth")).alias("label"))
    return stage(edges.distinct(), f"{name}-edges"), stage(states, f"{name}-start")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further."""
    rest, label, size = F.col("rest"), F.col("label"), F.length("label")
    here, there = F.substring("rest", 1, 1), F.substring("label", 1, 1)
    exact = F.substring(rest, F.lit(1), size) == label
    # a word's own path is in the trie, so another word parts from it at the first letter of an edge
    parts = (F.col("edits") == 0) & (here != there) & (rest != "")
    replaced = parts & (there > here) & (F.length(rest) >= size) & \
        (F.substring(rest, F.lit(2), size - 1) == F.substring(label, F.lit(2), size))
    skipped = parts & (F.substring(rest, F.lit(2), size) == label)
    moves = F.array_compact(F.array(
        F.when(exact, F.struct(_rest(rest, size).alias("rest"), F.col("edits").alias("edits"))),
        F.when(replaced, F.struct(_rest(rest, size).alias("rest"), F.lit(1).alias("edits"))),
        F.when(skipped, F.struct(_rest(rest, size + 1).alias("rest"), F.lit(1).alias("edits")))))
    met = states.select("id", "rest", "node", "edits").join(
        edges.hint("merge").select("node", "label", "child", F.col("ends").alias("child_ends")), "node")
    met = met.where((F.col("edits") == 0) | exact)
    return met.select("id", F.col("child").alias("node"), F.col("child_ends").alias("ends"), F.explode(moves).alias("move")) \
        .select("id", "move.rest", "node", "move.edits", "ends")


def _found(hashed: DataFrame, name: str) -> DataFrame:
    """``id, node``: the words, and the ends of those that differ from them by one letter in the second half."""
    edges, starts = _trie(hashed, name)
    last = edges.agg(F.max("level")).first()[0]
    names = ["id", "rest", "node", "edits", "ends"]
    frontier, states = None, []
    for level in range(-1 if last is None else last + 1):
        here = starts.where(F.col("level") == level).select(*names)
        if frontier is not None:
            here = here.unionByName(frontier)
        frontier = stage(_step(here, edges.where(F.col("level") == level)), f"{name}-frontier")
        states.append(frontier)
    found = starts.select(*names)
    for more in states:
        found = found.unionByName(more)
    left = F.length("rest")
    return found.where(F.col("ends") & (((F.col("edits") == 1) & (left == 0)) | ((F.col("edits") == 0) & (left == 1)))) \
        .select("id", "node")


def neighbours(words: DataFrame) -> DataFrame:
    """``a, b``: each pair of ids of ``words`` (word, id) that differ by one inserted, deleted or replaced code point, both ways."""
    found = None
    for name, letters in (("forward", F.col("word")), ("backward", F.reverse("word"))):
        hashed = stage(words.select("id", letters.alias("letters"))
                       .mapInArrow(_prefixes, "id bigint, letters string, nodes array<bigint>"), f"{name}-nodes")
        ends = hashed.select(F.col("id").alias("b"), F.element_at("nodes", -1).alias("node"))
        pairs = _found(hashed, name).join(ends.hint("merge"), "node").select(F.col("id").alias("a"), "b")
        found = pairs if found is None else found.unionByName(pairs)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    spelt = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    also = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"))
    sure = pairs.join(spelt.hint("merge"), "a").join(also.hint("merge"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    sure = stage(sure.select("a", "b"), "pairs")
    return sure.unionAll(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for each id with a form: the last one of its chain, by pointer doubling."""
    ahead = stage(forms.select("id", F.col("form").alias("root")), "ahead")
    while True:
        onward = ahead.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = stage(ahead.join(onward.hint("merge"), "root", "left")
                      .select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ahead")
        if moved.where("moved").isEmpty():
            return moved.select("id", "root")
        ahead = moved.select("id", "root")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             slips: int = SLIPS) -> DataFrame:
    """One row per word of the corpus: word, n, n_near, form, form_n, root.

    ``docs`` has doc_id and text; other columns are not read, so names cannot clash. Words
    are runs of Latin letters with A-Z in lower case; ``slips`` sets which runs lose a letter
    first (0: none). Every row counts, repeated ones too; a null id is the empty text; null
    and empty texts have no words; words may be of any length. Of near words that are equally
    frequent the smallest in code-point order is the form. Chains of forms end, since each is
    at least twice as frequent as the last. An empty table gives no rows.
    """
    if ratio < 2 or least_letters < 2:
        raise ValueError("the ratio and the least length must be two at least")
    bounded_batches(docs.sparkSession)
    words = vocabulary(docs, least_letters, least_count, slips)
    links = neighbours(words.select("word", "id"))
    near = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near", "b"))
    around = stage(links.join(near.hint("merge"), "b").groupBy(F.col("a").alias("id"))
                   .agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    judged = words.join(around.hint("merge"), "id", "left")
    taken = F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False))
    judged = stage(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("best")),
                   "judged")
    roots = _roots(judged.where("best IS NOT NULL").select("id", F.col("best.b").alias("form")))
    ends = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")).hint("merge"), "root") \
        .select("id", "root_word")
    return judged.join(ends.hint("merge"), "id", "left").select(
        "word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"))
