"""Packing documents into training windows by multiway differencing (Karmarkar-Karp).

Tokenizing cuts each document at fixed places: full windows, which are sequences of their
own, and a rest, of which an eighth and a thirty-second part are pieces of their own: the
small pieces let the method even out what the large ones leave. Only lengths and checksums
travel on. Pieces are dealt into groups of about ``group_windows`` windows; in each group the
largest differencing method merges the two partial partitions of largest imbalance, the
fullest windows of one with the emptiest of the other, until near-equal windows remain.
Their count starts at the least that could hold the group and rises whenever a window
exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, text_blocks
from hedgemark.llm.tokens import SpacedBytes, encoder, public_path
from hedgemark.sources.tables import stage

CAPACITY = 2048
#: Parts of a document's rest that are cut off it, and the least rest that is cut.
PARTS, LEAST_CUT = (8, 32), 64
GROUP_WINDOWS = 512

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, piece bigint"
PACKED = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def cuts(n: int, capacity: int) -> list[int]:
    """Where a document of ``n`` ids is cut: after each full window, then before the small parts of the rest."""
    bounds = list(range(0, n - n % capacity + 1, capacity))
    rest = n % capacity
    if rest >= LEAST_CUT:
        for part in range(len(PARTS)):
            bounds.append(n - sum(rest // p for p in PARTS[part:]))
    if rest:
        bounds.append(n)
    return bounds


def _pieces(frames: Iterator[pd.DataFrame], path: str, end_id: int, capacity: int) -> Iterator[pd.DataFrame]:
    coder, number = encoder(SpacedBytes, path), TaskContext.get().partitionId() << 32
    end = np.array([end_id], "<u4").tobytes()
    for frame in frames:
        ids_of = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        for at, texts in text_blocks(frame["text"].tolist()):
            rows = []
            for k, found in enumerate(coder.encode(texts)):
                ids = memoryview(found + end)
                bounds = cuts(len(ids) // 4, capacity)
                for a, b in zip(bounds, bounds[1:]):
                    rows.append((ids_of[at + k], a, b - a, crc32(ids[4 * a:4 * b]), len(ids) // 4, number))
                    number += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    """Two partial partitions as one: sums in falling order (zeros left out) and what each window holds."""
    (a_sums, a_held), (b_sums, b_held) = a, b
    both = len(a_sums) + len(b_sums) - k
    if both > 0:  # the emptiest windows of either that are not empty meet the fullest of the other
        cut = len(a_sums) - both
        tail = b_sums[len(b_sums) - both:][::-1]
        a_sums = np.concatenate([a_sums[:cut], a_sums[cut:] + tail])
        a_held = a_held[:cut] + [(x, y) for x, y in zip(a_held[cut:], b_held[len(b_held) - both:][::-1])]
        b_sums, b_held = b_sums[:len(b_sums) - both], b_held[:len(b_held) - both]
    sums = np.concatenate([a_sums, b_sums])
    held = a_held + b_held
    order = np.argsort(-sums, kind="stable")
    return sums[order], [held[i] for i in order.tolist()]


def _flat(held) -> list[int]:
    found, open_ = [], [held]
    while open_:
        x = open_.pop()
        if isinstance(x, tuple):
            open_ += x
        else:
            found.append(x)
    return found


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items dealt into ``k`` windows of near-equal sums by the largest differencing method; ties by item number."""
    heap = []
    for at, size in enumerate(sizes.tolist()):
        heap.append((-size if k > 1 else 0, at, (np.array([size], np.int64), [at])))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = _merge(a, b, k)
        sums = merged[0]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    return [_flat(h) for h in heap[0][2][1]] if heap else []


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; whenever the fullest exceeds it, their count rises by what the excess calls for."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = difference(sizes, k)
        over = max(int(sizes[w].sum()) for w in windows) - capacity
        if over <= 0:
            return windows
        k += max(1, over * k // capacity)


def _pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values("piece").reset_index(drop=True)
    windows = pack_sizes(frame["length"].to_numpy(), capacity)
    sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    lengths = frame["length"].to_numpy()
    for members in windows:
        members = np.sort(np.array(members))
        # the smallest piece number of a window is its own, so the id is unique among all sequences
        sequence[members] = frame["piece"].iloc[members[0]]
        offset[members] = np.cumsum(lengths[members]) - lengths[members]
    out = frame.drop(columns=["grp", "piece"]).assign(sequence_id=sequence, offset=offset)
    return out[[c.split()[0] for c in PACKED.split(", ")]]


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY,
                   group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole texts; a null or empty text is its end id alone. Repeated rows are packed each
    for itself; null ids are kept. An empty table packs nothing. Columns other than
    doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = path or public_path("byte_bpe_50k.json")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(slim.mapInPandas(
        lambda frames: _pieces(frames, vocabulary, end_id, capacity), PIECES), "pieces")
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("piece").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (capacity * group_windows)))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(lambda frame: _pack_group(frame, capacity), PACKED)
    return full.unionByName(packed)
