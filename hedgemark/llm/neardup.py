"""Near copies for the corpus pipeline: 5-word shingles, Jaccard similarity of at least 0.8.

Candidates are what the operator of ``simhash`` links: fingerprints at four or fewer
differing bits, found by pigeonhole blocks and checked bit by bit. That similarity needs 10
to 14 bits, whose blocks are too coarse to be buckets, so MinHash bands add what lies
further apart: of two texts at 0.8, all but one pair in 1,500 share a band. A class of
fingerprints and a band's bucket are linked as stars, so any size costs one link per text.
What these links connect is a candidate group, and only texts of groups travel. Each group is compared by exact Jaccard similarity, in blocks of bounded
size that all meet each other, and gives back a tree of links for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, lower_ascii
from hedgemark.llm.simhash import classes, components, fingerprint
from hedgemark.operators.joins import fits_broadcast
from hedgemark.sources.tables import stage

SHINGLE = 5
#: Similarity as a fraction of whole numbers: at least 4 of 5.
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 40, 8
#: Text bytes of a block of a candidate group; a task compares two blocks at once.
BLOCK_BYTES = 8 << 20
#: Shingles that meet all hash functions at once, and words a Python worker remembers.
HASHES = 1 << 10
MEMORY = 500_000

_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
_random = np.random.RandomState(42)
_FLIPS = _random.randint(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)
_FACTORS = _random.randint(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word runs (of all its words if they are fewer); its A-Z is lower case."""
    words = [w for w in (text or "").translate(_SPACES).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out ^= hashes[k:k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """The bucket of each band, as signed 64-bit numbers."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FLIPS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), HASHES):
        np.minimum(least, ((short[at:at + HASHES, None] ^ _FLIPS) * _FACTORS).min(0), out=least)
    data, width = least.tobytes(), 4 * BAND_ROWS
    keys = [xxhash.xxh64_intdigest(data[k * width:(k + 1) * width], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def _signed(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in columns:
        sets = [shingles(t) for t in texts]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pd.DataFrame({"node": node, "bands": [bands(s) for s in sets], "fp": fps})


def _tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets which chains of similar pairs connect: what is reached leaves the pool."""
    sizes = np.array([len(s) for s in sets])
    of_all, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    marked, (part, whole) = np.zeros(len(of_all), bool), SIMILAR
    pool, links = np.arange(len(sets)), []
    while len(pool) > 1:
        open_, pool = [pool[0]], pool[1:]
        joined = np.concatenate([ids[k] for k in pool])
        while open_ and len(pool):
            at = open_.pop()
            marked[ids[at]] = True
            shared = np.add.reduceat(marked[joined], np.cumsum(sizes[pool]) - sizes[pool], dtype=np.int64)
            marked[ids[at]] = False
            near = whole * shared >= part * (sizes[at] + sizes[pool] - shared)
            if near.any():
                links += [(at, k) for k in pool[near]]
                open_ += list(pool[near])
                joined, pool = joined[np.repeat(~near, sizes[pool])], pool[~near]
    return links


def _group_links(frame: pd.DataFrame) -> pd.DataFrame:
    nodes = frame["node"].to_numpy()
    links = _tree([shingles(t) for t in frame["text"]]) if len(nodes) > 1 else []
    at = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]})


def _key() -> Column:
    """What tells rows apart without their place in the table; rows of equal id and text are one."""
    return F.xxhash64("doc_id", "text")


def close_fingerprints(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` from the least shingle set of each SimHash class of ``rows`` (doc_id, node, fp) to its others."""
    held = rows.select("node", "fp").distinct().join(classes(rows.select("doc_id", "fp")).select("fp", "root").hint("merge"), "fp")
    held = stage(held.select("root", "node").distinct(), "fingerprint-classes")
    least = held.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z"))
    return held.join(least.select("root", "a").hint("merge"), "root").where(F.col("node") != F.col("a")) \
        .select("a", F.col("node").alias("b"))


def links_between(docs: DataFrame, rows: DataFrame, nodes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links ``a, b`` between shingle sets, enough to connect all that chains of similar pairs connect."""
    keyed = rows.select("node", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z"))
    met = stage(keyed.join(least.select("band", "a").hint("merge"), "band").where(F.col("node") != F.col("a"))
                .select("a", F.col("node").alias("b")).unionByName(close_fingerprints(rows)).distinct(), "met")
    ends = met.select(F.col("a").alias("fp")).union(met.select("b")).distinct()
    groups = components(ends, met).withColumnRenamed("fp", "node").join(nodes, "node")
    before = Window.partitionBy("root").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.select("root", "node", F.col("best.key").alias("__key"),
                           F.floor(F.sum("bytes").over(before) / F.lit(block_bytes)).alias("block"))
    groups = stage(groups.withColumn("last", F.max("block").over(Window.partitionBy("root"))), "groups")
    found = docs.select(_key().alias("__key"), lower_ascii(F.col("text")).alias("text")) \
        .join(groups.select("__key").hint("merge"), "__key", "left_semi") \
        .groupBy("__key").agg(F.first("text").alias("text"))
    texts = found.join(groups.hint("merge"), "__key") \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return stage(texts.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "text")
                 .groupBy("root", "i", "j").applyInPandas(lambda _, frame: _group_links(frame), "a bigint, b bigint"), "links")


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of ``docs`` for each group of near copies, that of the smallest id; columns stay as they were.

    Groups are closed under chains of pairs whose similarity is at least 0.8. Texts without
    words are one group. A null id stands for a group only if it has no other. Shingle sets
    and rows are told apart by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    sign = F.pandas_udf(_signed, "node bigint, bands array<bigint>, fp bigint")
    rows = docs.select("doc_id", _key().alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                       sign(lower_ascii(F.col("text"))).alias("s"))
    rows = stage(rows.select("doc_id", "key", "bytes", "s.node", "s.bands", "s.fp"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = stage(rows.groupBy("node").agg(F.min(order).alias("best"), F.max("bytes").alias("bytes")), "sets")
    links = links_between(docs, rows, nodes, block_bytes)
    of_node = components(nodes.select(F.col("node").alias("fp")), links).withColumnRenamed("fp", "node")
    stands = stage(nodes.join(of_node.hint("merge"), "node").groupBy("root").agg(F.min("best").alias("best"))
                   .select(F.col("best.key").alias("__key")), "stands")
    # the keys grow with the documents, so they are merged at every size, never broadcast because they happen to be few
    kept = docs.withColumn("__key", _key()).join(stands.hint("merge"), "__key", "left_semi")
    repeated = stage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
                     .select(F.col("key").alias("__key")), "repeated")
    if not repeated.isEmpty():
        again = F.broadcast(repeated) if fits_broadcast(repeated) else repeated
        kept = stage(kept, "kept")
        kept = kept.join(again, "__key", "left_anti").select(*kept.columns) \
            .unionByName(kept.join(again, "__key", "left_semi").select(*kept.columns).dropDuplicates(["__key"]))
    return kept.select(*docs.columns)
