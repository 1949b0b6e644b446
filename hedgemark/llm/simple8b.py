"""Token files in Simple-8b: ids of documents in ascending id order, packed into 64-bit words.

A word holds a 4-bit selector and 60 bits of data: so many ids of so many bits each, 60
ids of one bit down to one id of 60. Ids from ``ESCAPE`` on, which are rare, are written as
``ESCAPE`` in place and apart as 32-bit numbers, so that one of them does not thin out its
neighbours' word. A file row is a run of whole documents of about ``ROW_IDS`` ids; it is
coded in blocks of ``BLOCK_IDS`` that begin on a word of their own and whose word and escape
offsets are written beside them, so a block can be decoded alone and a row as array work.
The rows lie in Parquet files: ``shard`` (range of document ids), ``first`` (ids of the
shard before the row), ``doc_ids``, ``doc_tokens``, ``words``, ``escapes``, ``block_words``,
``block_escapes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, text_blocks
from hedgemark.llm.tokens import BareWords, encoder, public_path
from hedgemark.sources.tables import stage

#: Ids in a word and bits of each, by selector (fixed values of the format).
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 15) - 1
BLOCK_IDS = 2048
ROW_IDS = 1 << 18

ROW_SCHEMA = ("shard int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<int>, words binary, "
              "escapes binary, block_words binary, block_escapes binary")


def _selectors(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position, the selector of the word that would begin there: the first whose ids all fit and are
    among the ``left`` ids that its block still has."""
    n = len(values)
    width = np.zeros(n, np.uint8)
    for bits in range(int(values.max()).bit_length() if n else 0):
        width += values >= (1 << bits)
    top = {1: width}
    for count in sorted({c for c in COUNTS if 1 < c <= n}):
        half = max(k for k in top if 2 * k >= count)
        top[count] = np.maximum(top[half][:n - count + 1], top[half][count - half:])
    found = np.full(n, len(COUNTS) - 1, np.uint8)
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[selector]
        if count in top:
            fits = (top[count] <= BITS[selector]) & (left[:n - count + 1] >= count)
            found[:len(fits)][fits] = selector
    return found


def encode_run(ids: np.ndarray) -> dict[str, bytes]:
    """A run of ids below 2^32, its blocks walked side by side."""
    n = len(ids)
    values = ids.astype(np.uint32)
    escaped = values >= ESCAPE
    escapes = values[escaped]
    values[escaped] = ESCAPE
    begin = np.arange(0, n, BLOCK_IDS)
    end = np.minimum(begin + BLOCK_IDS, n)
    best = _selectors(values, np.repeat(end, end - begin) - np.arange(n))
    step = np.array(COUNTS, np.int64)[best]
    first = np.zeros(n, bool)  # of a word
    at, stop = begin, end
    while len(at):
        first[at] = True
        at = at + step[at]
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    starts = np.flatnonzero(first)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        for k in range(COUNTS[selector]):
            words[rows] |= values[starts[rows] + k].astype(np.uint64) << np.uint64(k * BITS[selector])
    bounds = np.append(begin, n)
    return {"words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u4").tobytes(),
            "block_words": np.searchsorted(starts, bounds).astype("<u4").tobytes(),
            "block_escapes": np.searchsorted(np.flatnonzero(escaped), bounds).astype("<u4").tobytes()}


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any run of whole blocks."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS, np.int64)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint32)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        part, mask = words[rows], np.uint64((1 << BITS[selector]) - 1)
        for k in range(COUNTS[selector]):
            out[starts[rows] + k] = (part >> np.uint64(k * BITS[selector])) & mask
    out[out == ESCAPE] = escapes
    return out


def decode_run(words: bytes, escapes: bytes) -> np.ndarray:
    return decode(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u4"))


def decode_one_block(words: bytes, escapes: bytes, block_words: bytes, block_escapes: bytes, block: int) -> np.ndarray:
    """One block by its offsets, without touching the others."""
    at, esc = np.frombuffer(block_words, "<u4"), np.frombuffer(block_escapes, "<u4")
    return decode(np.frombuffer(words, "<u8")[at[block]:at[block + 1]],
                  np.frombuffer(escapes, "<u4")[esc[block]:esc[block + 1]])


def _rows_of(frames: Iterator[pd.DataFrame], path: str, end_id: int, row_ids: int) -> Iterator[pd.DataFrame]:
    """File rows of one shard, whose documents come in their final order."""
    coder, shard = encoder(BareWords, path), TaskContext.get().partitionId()
    end, first = np.array([end_id], "<u4").tobytes(), 0
    doc_ids, runs, size = [], [], 0

    def row() -> pd.DataFrame:
        tokens = [len(r) // 4 for r in runs]
        ids = np.frombuffer(b"".join(runs), "<u4")
        return pd.DataFrame([{"shard": shard, "first": first, "n_ids": len(ids), "doc_ids": doc_ids,
                              "doc_tokens": tokens, **encode_run(ids)}])

    for frame in frames:
        ids_of = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        for at, texts in text_blocks(frame["text"].tolist()):
            for k, found in enumerate(coder.encode(texts)):
                doc_ids.append(ids_of[at + k])
                runs.append(found + end)
                size += len(found) // 4 + 1
                if size >= row_ids:
                    yield row()
                    first, doc_ids, runs, size = first + size, [], [], 0
    if runs:
        yield row()


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, row_ids: int = ROW_IDS) -> DataFrame:
    """Encode ``doc_id, text`` and write the file rows to the shared folder; returns the files, reread.

    Whole texts; a null or empty text is the end id alone. Equal doc_ids are ordered by
    their texts' hash, so any number of them can be split between shards; null ids come
    first. An empty table writes no rows. Other columns are dropped before the shuffle.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = path or public_path("word_bpe_49k.json")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc(), F.col("tie").asc()) \
        .sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = ordered.mapInPandas(lambda frames: _rows_of(frames, vocabulary, end_id, row_ids), ROW_SCHEMA)
    return stage(rows, "token-files")


def _documents_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from zlib import crc32

    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            ids = decode_run(row.words, row.escapes).astype("<u4", copy=False)
            bounds = np.cumsum([0, *row.doc_tokens])
            out.append(pd.DataFrame({
                "doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "start": row.base + row.first + bounds[:-1],
                "n_tokens": np.diff(bounds), "ids_crc32": [crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]}))
        if out:
            yield pd.concat(out)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = files.sparkSession
    sizes = files.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("n")).collect()  # a row per shard
    base, total = [], 0
    for row in sorted(sizes, key=lambda r: r["shard"]):
        base.append((row["shard"], total))
        total += row["n"]
    bases = spark.createDataFrame(base, "shard int, base bigint")
    joined = files.join(F.broadcast(bases), "shard").select("base", "first", "doc_ids", "doc_tokens", "words", "escapes")
    return joined.mapInPandas(_documents_of, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
