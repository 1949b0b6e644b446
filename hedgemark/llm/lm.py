"""Language-model scoring with a sharded Elias-Fano trigram trie.

Texts are read once into chunks of whole documents with a dictionary each. A chunk sends its
different words with their counts in learning documents to word shards, which add them up
and answer with ids (frequent words have small ones) and totals. Each chunk then sends its
different trigrams, with their counts in learning documents, to shards by their middle word
(and by the last word, too, where the middle word is so frequent that one shard would not do).
A shard adds up the counts, builds its trie, and answers from the memory-mapped levels for
every chunk's list, in the list's order. Scores follow in the chunk. Smoothing is
interpolation with a Dirichlet prior at each order, which needs no more than these counts:

    p1(w) = (c(w) + 1/2) / (N + (V + 1) / 2)
    p2(w | v) = (c(vw) + m2 p1(w)) / (c(v) + m2)
    p3(w | uv) = (c(uvw) + m3 p2(w | v)) / (c(uv) + m3)

The trie's quantised counts are rounded down above the line and up below it, so that the
model never adds up to more than one.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, sums_between
from hedgemark.llm.eliasfano import Trie, least, most
from hedgemark.sources.tables import stage


#: Id of the words that no learning document has.
NONE = (1 << 32) - 1


@dataclass(frozen=True)
class Settings:
    """``chunk_tokens``: tokens of whole documents that are worked on together. ``shard_tokens``: tokens for each shard.
    ``m2``, ``m3``: weight of the lower order, in occurrences."""

    chunk_tokens: int = 800_000
    shard_tokens: int = 1_000_000
    m2: float = 1000.0
    m3: float = 50.0


CHUNKS = ("chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, ids binary, "
          "words array<struct<shard:int,places:binary,words:binary>>, n_words int, n_learned bigint, n_learned_docs bigint")
WORDS = "chunk bigint, shard int, known binary, n_words bigint, largest bigint"
SENT = "chunk bigint, shard int, grams binary"
ANSWERED = "chunk bigint, shard int, codes binary"
SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, byte by byte position, compressed."""
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a))
    return struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack(f"<{len(kinds)}q", data[:8 * len(kinds)])
    body, at, out = zstandard.ZstdDecompressor().decompress(data[8 * len(kinds):]) if sum(sizes) else b"", 0, []
    for size, kind in zip(sizes, kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * width
    return out


#: About so many bytes of text for each token, to choose the number of shards by.
BYTES_A_TOKEN = 6


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _word_shards(words: list[bytes], counts: np.ndarray, n_shards: int) -> list[dict]:
    shard = np.fromiter((crc32(w) % n_shards for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(n_shards + 1))
    out = []
    for k in np.flatnonzero(np.diff(bounds)):
        places = order[bounds[k]:bounds[k + 1]]
        joined = zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[p] for p in places.tolist()]))
        out.append({"shard": int(k), "words": joined,
                    "places": _packed(places.astype("<u4"), counts[places].astype("<u4"))})
    return out


def _chunks(frames: Iterator[pd.DataFrame], chunk_tokens: int, n_shards: int) -> Iterator[pd.DataFrame]:
    """Local number 0 is the end of a text; the others are words in order of appearance."""
    part, number = TaskContext.get().partitionId(), 0
    docs, held, lengths, runs, size, numbers = [], [], [], [], 0, _Numbers({b"": 0})

    def row() -> pd.DataFrame:
        ids = np.concatenate(runs)
        learned = np.repeat(~np.array(held), lengths)
        counts = np.bincount(ids[learned], minlength=len(numbers))
        return pd.DataFrame([{
            "chunk": (part << 32) | number, "doc_ids": docs, "held": held, "lengths": lengths, "ids": _packed(ids),
            "words": _word_shards(list(numbers)[1:], counts[1:], n_shards), "n_words": len(numbers) - 1,
            "n_learned": int(learned.sum()), "n_learned_docs": len(held) - sum(held)}])

    for frame in frames:
        for doc_id, text, out in zip(frame["doc_id"], frame["text"], frame["held_out"]):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
            ids = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            docs.append(None if pd.isna(doc_id) else int(doc_id))
            held.append(bool(out))
            lengths.append(len(words) + 1)
            runs.append(np.append(ids, np.uint32(0)))
            size += len(words) + 1
            if size >= chunk_tokens:
                yield row()
                docs, held, lengths, runs, size, numbers = [], [], [], [], 0, _Numbers({b"": 0})
                number += 1
    if docs:
        yield row()


def _known_words(frame: pd.DataFrame, n_shards: int) -> pd.DataFrame:
    """One word shard: totals over all chunks; ids by falling count, interleaved with those of the other shards.

    A word of no learning document has the id ``NONE``.
    """
    shard, totals, lists = int(frame["shard"].iloc[0]), {}, []
    for words, places in zip(frame["words"], frame["places"]):
        words = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
        place, counts = _unpacked(places, "<u4", "<u4")
        lists.append((words, place))
        for word, n in zip(words, counts.tolist()):
            totals[word] = totals.get(word, 0) + n
    order = sorted([w for w, n in totals.items() if n], key=lambda w: (-totals[w], w))
    if len(order) * n_shards >= NONE - n_shards:
        raise ValueError("word ids are 32-bit")
    ids = {w: k * n_shards + shard for k, w in enumerate(order)}
    known = [_packed(place, np.array([ids.get(w, NONE) for w in words], "<u4"), np.array([totals[w] for w in words], "<i8"))
             for words, place in lists]
    return pd.DataFrame({"chunk": frame["chunk"], "shard": shard, "known": known,
                         "n_words": len(order), "largest": max(ids.values(), default=-1)})


def _new_runs(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Chunk:
    """A chunk's tokens under global ids, and its different trigrams in the order in which they are sent."""

    def __init__(self, row, span: int, n_docs: int, n_shards: int, settings: Settings):
        end, begin = span - 2, span - 1
        ids, = _unpacked(row.ids, "<u4")
        word_id = np.full(row.n_words + 1, NONE, np.uint32)
        word_count = np.zeros(row.n_words + 1, np.int64)
        word_id[0], word_count[0] = end, n_docs
        for known in row.known if row.known is not None else ():
            place, gid, count = _unpacked(known, "<u4", "<u4", "<i8")
            word_id[place + np.uint32(1)], word_count[place + np.uint32(1)] = gid, count
        self.lengths = np.array(row.lengths, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        starts = self.bounds[:-1]

        def after(values: np.ndarray, at_start: int) -> np.ndarray:
            moved = np.empty_like(values)
            moved[1:] = values[:-1]
            moved[starts] = at_start
            return moved

        self.last, self.count = word_id[ids], word_count[ids]
        middle, self.middle_count = after(self.last, begin), after(self.count, n_docs)
        left = after(middle, begin)
        # what is in no learning document cannot be in the model, nor what follows it
        self.asked = np.flatnonzero((self.last != NONE) & (middle != NONE))
        left, middle, last = left[self.asked], middle[self.asked], self.last[self.asked]
        splits = 1 + self.middle_count[self.asked] // settings.shard_tokens
        shard = last.astype(np.int64) * 0x9E3779B1 % 0x7FFFFFFF % splits
        shard *= 0xC2B2AE3D
        shard += middle.astype(np.int64) * 0x85EBCA77
        shard = (shard % 0x7FFFFFFFFFFF % n_shards).astype(np.int32)
        order = np.lexsort((last, left, middle, shard))
        left, middle, last, shard = left[order], middle[order], last[order], shard[order]
        new = _new_runs(shard, middle, left, last)
        self.gram = np.empty(len(order), np.int32)
        self.gram[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        learned = np.repeat(~np.array(row.held, bool), self.lengths)[self.asked][order]
        self.counts = np.add.reduceat(learned, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        self.left_of, self.middle_of, self.last_of, self.shard_of = left[at], middle[at], last[at], shard[at]

    def sent(self, chunk: int) -> list[tuple[int, int, bytes]]:
        shards, starts = np.unique(self.shard_of, return_index=True)
        ends = np.append(starts[1:], len(self.shard_of))
        out = []
        for shard, a, b in zip(shards.tolist(), starts, ends):
            middle = np.diff(self.middle_of[a:b], prepend=np.uint32(0))  # rising, so small steps
            out.append((chunk, shard, _packed(middle, self.left_of[a:b], self.last_of[a:b],
                                              self.counts[a:b].astype("<u4"))))
        return out

    def scores(self, row, codes: dict[int, bytes], n_tokens: int, n_words: int, n_docs: int,
               settings: Settings) -> pd.DataFrame:
        half = n_tokens + 0.5 * (n_words + 1)
        base = (self.count + 0.5) / half
        two, three = np.zeros(len(self.counts), np.uint16), np.zeros(len(self.counts), np.uint16)
        shards, starts = np.unique(self.shard_of, return_index=True)
        for shard, a, b in zip(shards.tolist(), starts, np.append(starts[1:], len(self.shard_of))):
            two[a:b], three[a:b] = _unpacked(codes[shard], "<u2", "<u2")
        code2, code3 = np.zeros(len(self.last), np.uint16), np.zeros(len(self.last), np.uint16)
        code2[self.asked], code3[self.asked] = two[self.gram], three[self.gram]
        pair_count = np.concatenate([[n_docs], most(code2)[:-1]])  # of the two words before
        pair_count[self.bounds[:-1]] = n_docs
        p2 = (least(code2) + settings.m2 * base) / (self.middle_count + settings.m2)
        p3 = (least(code3) + settings.m3 * p2) / (pair_count + settings.m3)
        totals = [np.add.reduceat(np.log10(p), self.bounds[:-1]) for p in (base, p3)]
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"),
            "held_out": np.array(row.held, bool), "n_tokens": self.lengths,
            "n_known": sums_between(self.count > 0, self.bounds), "train_tokens": n_tokens,
            "base_score": totals[0], "score": totals[1]})


def _answers(frame: pd.DataFrame, span: int) -> pd.DataFrame:
    """One shard: the lists of all chunks added up, the trie built and mapped, each list answered in its order."""
    lists = [_unpacked(g, "<u4", "<u4", "<u4", "<u4") for g in frame["grams"]]
    sizes = [len(x[1]) for x in lists]
    middle = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in lists])
    left, last, counts = (np.concatenate([x[k] for x in lists]) for k in (1, 2, 3))
    del lists
    order = np.lexsort((last, left, middle))
    middle, left, last = middle[order], left[order], last[order]
    new = _new_runs(middle, left, last)
    at = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], at, dtype=np.int64)
    where = np.empty(len(order), np.int32)
    where[order] = np.cumsum(new) - 1
    middle, left, last = middle[at], left[at], last[at]
    del order, new, at, counts
    held = sums > 0
    with tempfile.TemporaryFile() as file:
        Trie.build(middle[held], left[held], last[held], sums[held], span).write(file)
        two, three = Trie.mapped(file).find(middle, left, last)
    two, three = two[where], three[where]
    bounds = np.cumsum([0, *sizes])
    codes = [_packed(two[a:b], three[a:b]) for a, b in zip(bounds, bounds[1:])]
    return pd.DataFrame({"chunk": frame["chunk"], "shard": frame["shard"], "codes": codes})


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``doc_id, text, held_out``: n_tokens, n_known, train_tokens, base_score and score (log10).

    The model learns from rows that are not held out, and scores all. Whole texts; a null
    or empty text is its end alone. A null id is kept, a null ``held_out`` counts as
    learning. Repeated rows learn and score each for itself. With nothing to learn from, all
    words are unknown. An empty table gives no rows. Other columns are dropped first.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce("held_out", F.lit(False)).alias("held_out"))
    # texts are read twice: bytes first, for the number of shards
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, round(size / (BYTES_A_TOKEN * settings.shard_tokens)))
    chunks = stage(slim.mapInPandas(lambda frames: _chunks(frames, settings.chunk_tokens, n_shards), CHUNKS), "chunks")
    n_learned, n_docs = (int(x or 0) for x in chunks.agg(F.sum("n_learned"), F.sum("n_learned_docs")).first())
    asked = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.shard", "w.places", "w.words")
    words = stage(asked.groupBy("shard").applyInPandas(lambda frame: _known_words(frame, n_shards), WORDS), "words")
    sums = words.groupBy("shard").agg(F.max("n_words").alias("n"), F.max("largest").alias("largest")) \
        .agg(F.sum("n"), F.max("largest")).first()
    distinct = int(sums[0] or 0) + (n_docs > 0)  # the end is a token, too
    span = int(-1 if sums[1] is None else sums[1]) + 3
    known = words.groupBy("chunk").agg(F.collect_list("known").alias("known"))
    tokens = chunks.select("chunk", "doc_ids", "held", "lengths", "ids", "n_words").join(known, "chunk", "left")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                chunk = _Chunk(row, span, n_docs, n_shards, settings)
                yield pd.DataFrame(chunk.sent(row.chunk), columns=["chunk", "shard", "grams"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes = {c["shard"]: c["codes"] for c in row.codes} if row.codes is not None else {}
                chunk = _Chunk(row, span, n_docs, n_shards, settings)
                yield chunk.scores(row, codes, n_learned, distinct, n_docs, settings)

    sent = tokens.mapInPandas(send, SENT)
    answers = stage(sent.groupBy("shard").applyInPandas(lambda frame: _answers(frame, span), ANSWERED), "answers")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes")).alias("codes"))
    return tokens.join(by_chunk, "chunk", "left").mapInPandas(score, SCORED)
