"""Removal of repeated passages by difference-cover anchors.

A passage of ``window`` words that stands at two places may begin anywhere, but if only the
positions of a difference cover modulo ``period`` are hashed, then whatever the distance of
the two places there is one offset below ``period`` at which both are at such a position.
So five of 21 word positions are hashed, over so many words that an anchor at any offset
still lies inside the window. Anchors that occur once are done with. Around the others the
match is extended: every whole window that holds one is hashed, and those that occur twice
are removed.

Occurrences are counted, never paired: a text hands on each hash once, counts are combined
before they are shuffled, and what occurs twice comes back to its texts, where positions are
worked out again. Texts are shuffled once, for both visits after the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgemark.llm.common import bounded_batches
from hedgemark.sources.tables import stage

WINDOW, PERIOD = 35, 21
#: Bytes of text that are worked on at once, and rows of a batch that goes back to Spark.
BLOCK, ROWS = 1 << 20, 1 << 16


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences give every residue modulo ``period``."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError(f"no cover of period {period}")


_BASE = 0xD1342543DE82EF95
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([k])) for k in range(256)), np.uint64)


@dataclass(frozen=True)
class Block:
    """Some whole texts as bytes: hashes of all words, where they begin and end, and the first word of each text."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text(self) -> np.ndarray:
        """For each word the text it stands in."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place in its text, and how many words are left from it on."""
        place = np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.sizes)
        return place, np.repeat(self.sizes, self.sizes) - place

    def of_rows(self, column: pa.ListArray) -> np.ndarray:
        """The values of a list column of the batch, for all texts of the block together."""
        return column.slice(self.first, len(self.sizes)).flatten().to_numpy(zero_copy_only=False)

    def joined(self, row: int, left: np.ndarray | None = None) -> bytes:
        first, end = self.bounds[row], self.bounds[row + 1]
        if first == end:
            return b""
        found = self.data[self.starts[first]:self.ends[end - 1]].tobytes().split()
        return b" ".join(found if left is None else [w for w, stays in zip(found, left[first:end]) if stays])


def _block(first: int, data: np.ndarray, offsets: np.ndarray) -> Block:
    """Words are runs without ASCII white space; a word's hash is a polynomial over its bytes, all worked out at once."""
    inside = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    before[offsets] = False  # no word goes on from one text to the next
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.append(inside, False)
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _BASE, np.uint64)]))
    np.cumsum(_LETTERS[data] * powers[:-1], out=sums[1:])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _BACK, np.uint64)]))
    hashes = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    hashes ^= hashes >> np.uint64(31)
    return Block(first, data, hashes, starts, ends, np.searchsorted(starts, offsets))


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The texts of a batch in blocks of about ``BLOCK`` bytes; a longer text is a block of its own."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for row, n in enumerate([*sizes.tolist(), None]):
        if row > first and (n is None or size + n > BLOCK):
            part = texts[first:row]
            data = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
            yield _block(first, data, np.concatenate([[0], np.cumsum(sizes[first:row])]).astype(np.int64))
            first, size = row, 0
        size += n or 0


def _mixed(hashes: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hash of the ``size`` words from each start."""
    out = np.full(len(starts), seed, np.uint64)
    for k in range(size):
        out ^= hashes[starts + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _rows(parts: list[tuple[np.ndarray, ...]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*parts)]
    for at in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + ROWS]) for c in columns], list(names))


def _gathered(each: Iterator[tuple[np.ndarray, ...]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for part in each:
        if len(part[0]):
            parts.append(part)
            rows += len(part[0])
        if rows >= ROWS:
            yield from _rows(parts, names)
            parts, rows = [], 0
    if rows:
        yield from _rows(parts, names)


def _anchor_places(block: Block, window: int, period: int) -> np.ndarray:
    """Words at a cover position of their text from which a whole anchor is left, in texts that hold a window."""
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    place, left = block.place
    return np.flatnonzero(cover[place % period] & (left >= window - period + 1) & (place + left >= window))


def _distinct(texts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of each text is found first, and whether the text has it once (1) or more often (2)."""
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    same = (texts[1:] == texts[:-1]) & (values[1:] == values[:-1])
    first = ~np.concatenate([np.zeros(min(1, len(order)), bool), same])
    twice = np.append(same, False)[:len(order)]
    return order[first], 1 + twice[first].astype(np.int8)


def anchors(texts: DataFrame, window: int, period: int) -> DataFrame:
    """``anchor``, ``key``, ``n``: the distinct hashes at the cover positions of each text (``key``, ``text``), 2 if it has one twice."""
    size = window - period + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                keys = batch.column("key").to_numpy()
                for block in _blocks(batch):
                    at = _anchor_places(block, window, period)
                    values, of = _mixed(block.hashes, at, size, size).view(np.int64), block.text[at]
                    first, n = _distinct(of, values)
                    yield values[first], keys[block.first + of[first]], n

        return _gathered(each(), ("anchor", "key", "n"))

    return texts.mapInArrow(found, "anchor bigint, key bigint, n tinyint")


def _starts(block: Block, ats: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows that wholly hold one of the anchors."""
    marks = np.zeros(len(block.hashes) + 1, np.int32)
    np.add.at(marks, np.maximum(ats - (period - 1), block.bounds[block.text[ats]]), 1)
    marks[ats + 1] -= 1
    return np.flatnonzero((marks.cumsum()[:-1] > 0) & (block.place[1] >= window))


def _windows(marked: DataFrame, window: int, period: int) -> DataFrame:
    """``h``, ``g`` (96 bits of a window), ``key``, ``n``: the distinct windows around each text's ``anchors``, 2 if it has one twice."""
    size = window - period + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                keys, repeated = batch.column("key").to_numpy(), batch.column("anchors")
                for block in _blocks(batch):
                    at = _anchor_places(block, window, period)
                    # an anchor that is repeated is so for every text that has it
                    known = np.isin(_mixed(block.hashes, at, size, size).view(np.int64), block.of_rows(repeated))
                    starts = _starts(block, at[known], window, period)
                    values, of = _mixed(block.hashes, starts, window, 0).view(np.int64), block.text[starts]
                    first, n = _distinct(of, values)
                    second = (_mixed(block.hashes, starts[first], window, 1) >> np.uint64(32)).astype(np.uint32)
                    yield values[first], second.view(np.int32), keys[block.first + of[first]], n

        return _gathered(each(), ("h", "g", "key", "n"))

    return marked.mapInArrow(found, "h bigint, g int, key bigint, n tinyint")


def _staying(block: Block, hits: np.ndarray, texts: np.ndarray, window: int) -> np.ndarray:
    """For each word whether it stays: it is in no window of the given hashes. Only ``texts`` (a mask) are looked at."""
    starts = np.flatnonzero(texts[block.text] & (block.place[1] >= window))
    at = starts[np.isin(_mixed(block.hashes, starts, window, 0).view(np.int64), hits)]
    marks = np.zeros(len(block.hashes) + 1, np.int32)
    marks[at] += 1
    np.add.at(marks, at + window, -1)
    return marks.cumsum()[:-1] <= 0


def remove_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """One row per document row: ``keep``, n_words, n_removed, and ``text``, the words that are left joined by one space.

    A word goes if some run of ``window`` words over it also starts at another place, in any
    row or in the same; all runs are judged on the input. So all words of a text of at least
    ``window`` words that is there twice go, repeated rows included, and shorter texts keep
    theirs. Words are compared as they are. Null and empty texts have no words and become the
    empty text. Equal and null ids are rows like any other. An empty table gives no rows.
    Columns not in ``keep`` are not read, so their names cannot clash; ``keep`` must not name
    the three results.
    """
    if not 0 < period <= window:
        raise ValueError("the period must lie between one and the window")
    bounded_batches(docs.sparkSession)
    # the key is no identity: it only brings a text and its finds together, and a find holds for every text that has it
    texts = docs.select(F.xxhash64("text").alias("key"), F.struct(*keep).alias("doc"), "text")
    placed = anchors(texts.select("key", "text"), window, period)
    twice = placed.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # counts grow with the texts, so they are merged at every size, never broadcast because they happen to be few
    marked = stage(placed.join(twice.hint("merge"), "anchor", "left_semi")
                   .groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "anchored")
    around = texts.join(marked.hint("merge"), "key")
    windows = _windows(around, window, period)
    again = windows.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g")
    hits = windows.join(again.hint("merge"), ["h", "g"], "left_semi") \
        .groupBy("key").agg(F.collect_set("h").alias("hits"))
    judged = texts.join(hits.hint("merge"), "key", "left")
    schema = T.StructType([judged.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, left, hits = [], [], [], batch.column("hits")
            for block in _blocks(batch):
                found = pc.is_valid(hits.slice(block.first, len(block.sizes))).to_numpy(zero_copy_only=False)
                stays = _staying(block, block.of_rows(hits), found, window)
                total = np.concatenate([[0], np.cumsum(~stays)])[block.bounds]
                gone = np.diff(total).tolist()
                counts += block.sizes.tolist()
                removed += gone
                left += [block.joined(row, stays if n else None) for row, n in enumerate(gone)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(left, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "text"])

    return judged.mapInArrow(cut, schema).select("doc.*", "n_words", "n_removed", "text")
