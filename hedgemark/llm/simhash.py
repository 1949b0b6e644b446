"""Near-duplicate groups by SimHash with pigeonhole blocks.

Documents of one fingerprint are one node, so copies cost nothing further. The 64 bits
are split into blocks; two fingerprints that differ in at most ``distance`` bits agree
in all but that many blocks, hence in some choice of the others. Each choice is a table
keyed by those blocks, and only fingerprints that meet in a bucket are compared.

A bucket is one row and is compared as array work; it gives back a spanning set of its
links (a tree for each part), never all pairs. Buckets above ``bucket_limit`` are not
compared: their fingerprints go on to the next round, which splits into more blocks and
so into finer buckets. A link whose bucket was too large joins two fingerprints that both
went on, so no link is lost; with blocks of at most ``64 * distance / blocks`` free bits the
buckets end up bounded by construction. Parts are then joined by repeated
smallest-neighbour rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, lower_ascii
from hedgemark.operators.joins import fits_broadcast
from hedgemark.sources.tables import stage

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints (8 bytes each) of a bucket that one task compares.
BUCKET_LIMIT = 20_000
#: Fingerprints that are hashed at once.
HASHES = 1 << 15

#: Separators of this operator's words, as Python sees them.
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text whose A-Z is lower case: bits set in over half the shingle hashes (none: zero)."""
    words = [w for w in (text or "").translate(_SPACES).split(" ") if w]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = [" ".join(words[i:i + shingle]).encode("utf-8", "surrogatepass")
              for i in range(max(1, len(words) - shingle + 1))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(joined), HASHES):
        hashes = np.array([digest(s, seed) for s in joined[at:at + HASHES]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(joined)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in columns:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """Signed 64-bit fingerprint of each text."""
    return F.pandas_udf(_fingerprints, "bigint")(lower_ascii(text))


def _spanning(found: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A tree of links for each part of a bucket: what is linked leaves the pool, so each is reached once."""
    pool, links = found, []
    while len(pool) > 1:
        open_, pool = [pool[0]], pool[1:]
        while open_ and len(pool):
            at = open_.pop()
            near = np.bitwise_count(pool ^ at) <= distance
            if near.any():
                reached = pool[near]
                links += [(int(at), int(x)) for x in reached]
                open_ += list(reached)
                pool = pool[~near]
    return links


def _bucket_links(frames: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        links = [pair for bucket in frame["fps"]
                 for pair in _spanning(np.sort(np.asarray(bucket, np.int64)).view(np.uint64), distance)]
        yield pd.DataFrame(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def _block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, the bits they cover (as signed 64-bit numbers)."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def first_blocks(n: int, distance: int) -> int:
    """Least count of blocks whose buckets hold about one of ``n`` evenly spread fingerprints, two above the distance at least."""
    blocks = distance + 2
    while blocks < 18 and 64 * (blocks - distance) / blocks < np.log2(max(n, 2)):
        blocks += 1
    return blocks


def links_between(nodes: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` that chains of close pairs connect."""
    rest, n = nodes, nodes.count()
    blocks, found = first_blocks(n, distance), None
    while True:
        masks = F.array(*[F.lit(m) for m in _block_masks(blocks, distance)])
        keyed = rest.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("part", "key"))
        sizes = stage(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit), "large")
        large = sizes.count()
        if large:
            keyed = keyed.join(sizes, ["part", "key"], "left_anti")
        buckets = keyed.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        links = stage(buckets.select("fps").mapInPandas(
            lambda frames: _bucket_links(frames, distance), "a bigint, b bigint"), "links")
        found = links if found is None else found.unionByName(links)
        if not large:
            return found
        again = rest.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("part", "key"))
        rest = stage(again.join(sizes, ["part", "key"], "left_semi").select("fp").distinct(), "crowded")
        blocks += 1


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, root`` for every node: the smallest node (as a signed number) it is connected to.

    Each round links every node to the smallest of its neighbourhood, first among the
    larger ones and then among the smaller ones (alternating stars); rounds are few, since
    a chain halves each time.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = around.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    state, before = stage(links.where(F.col("a") != F.col("b")).distinct(), "star"), None
    while True:
        state = stage(stars(stars(state, True), False), "star")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = state.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["fp"] == roots["a"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(rows: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fp, root, component_id`` for the distinct fingerprints of ``rows`` (doc_id, fp)."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    only = nodes.select("fp")
    linked = stage(nodes.join(components(only, links_between(only, distance, bucket_limit)), "fp"), "linked")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stage(linked.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "classes")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text")).alias("fp")),
                 "fingerprints")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document row: doc_id, ``fp`` (signed fingerprint), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and are linked like any other. Repeated rows
    and equal ids fall into one component. Null ids are kept; they count only if a
    component has no other id. An empty table gives no rows. Other columns are not read.
    """
    rows = fingerprint_rows(docs)
    return rows.join(classes(rows, distance, bucket_limit), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each; columns stay as they were.

    It is the row of the smallest id. Ids that occur once are told by the id alone; only
    rows of repeated or null ids are looked at again, by their fingerprint, and of several
    that could stand for a component one is taken.
    """
    rows = fingerprint_rows(docs)
    of_fp = classes(rows, distance, bucket_limit)
    marked = rows.join(of_fp, "fp")
    ids = stage(marked.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stands")), "ids")
    single = ids.where((F.col("n") == 1) & F.col("stands") & F.col("doc_id").isNotNull()).select("doc_id")
    # the ids grow with the documents, so they are merged at every size, never broadcast because they happen to be few
    kept = docs.join(single.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    several = ids.where(F.col("stands") & ((F.col("n") > 1) | F.col("doc_id").isNull())) \
        .select(F.col("doc_id").alias("__again"))
    if several.isEmpty():
        return kept
    few = F.broadcast(several) if fits_broadcast(several) else several
    # written first, or the planner works the fingerprints out below the join, for all rows
    rest = stage(docs.join(few, F.col("doc_id").eqNullSafe(F.col("__again")), "left_semi")
                 .select(F.struct(*docs.columns).alias("whole")), "repeated")
    rest = rest.select("whole", fingerprints(F.col("whole.text")).alias("fp"))
    chosen = rest.join(of_fp, "fp").where(F.col("whole.doc_id").eqNullSafe(F.col("component_id"))) \
        .dropDuplicates(["root", "fp"])
    # rows of one id in several fingerprints of one component: the least fingerprint stands for it
    least = chosen.groupBy("root").agg(F.min("fp").alias("fp"))
    named = chosen.join(least, ["root", "fp"], "left_semi")
    return kept.unionByName(named.select("whole.*"))
