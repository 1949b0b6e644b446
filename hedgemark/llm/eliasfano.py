"""Elias-Fano sequences and the n-gram trie made of them, as flat arrays that can be memory-mapped.

A sequence of n rising numbers below u keeps log2(u/n) low bits of each in a packed array
and the rest as unary gaps in a bitmap; a count of ones before each bitmap word finds any
element, and the first element not below a number, without decoding the others.

The trie has the last context word at its root. Level 1 holds context words; level 2 the
successors of each and, beside them, the words that came before it; level 3 the successors
of such a pair, written as their rank among the successors of the context word alone.
Lists of one level are joined into one rising sequence by adding where the list begins.
Each n-gram's count is quantised: exact up to 256, then in steps of one per cent, rounded down.
"""

from __future__ import annotations

import struct

import numpy as np

U8 = np.uint64
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _rank] = _bit
#: Queries worked on at once.
SLICE = 1 << 17

LEVELS = np.unique(np.concatenate([np.arange(257), (256 * 1.01 ** np.arange(1, 2600)).astype(np.int64)]))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Codes of counts, rounded down."""
    return (np.searchsorted(LEVELS, counts, "right") - 1).astype(np.uint16)


def least(codes: np.ndarray) -> np.ndarray:
    return LEVELS[codes]


def most(codes: np.ndarray) -> np.ndarray:
    return LEVELS[np.minimum(codes.astype(np.int64) + 1, len(LEVELS) - 1)] - 1


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the ``rank``-th set bit (from 0) of each word."""
    parts = words.reshape(-1, 1).view(np.uint8).reshape(-1, 8)
    before = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    at = (before <= rank[:, None]).sum(1)
    rows = np.arange(len(words))
    passed = np.where(at > 0, before[rows, np.maximum(at, 1) - 1], 0)
    return at * 8 + _SELECT[parts[rows, at], rank - passed]


class EliasFano:
    """A rising sequence: ``n``, low-bit width, packed low bits, high bitmap, ones before each bitmap word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U8)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> U8(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((((top >> width) + n + 1) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros(1, U8)
        if width and n:
            packed = ((values[:, None] >> np.arange(width, dtype=U8)) & U8(1)).astype(np.uint8)
            packed = np.packbits(packed.reshape(-1), bitorder="little")
            low = np.zeros(len(packed) // 8 + 2, U8)
            low.view(np.uint8)[:len(packed)] = packed
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, width, low, high, ones.astype(np.int64))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U8)
        bit = at.astype(np.int64) * self.width
        word, shift = bit >> 6, (bit & 63).astype(U8)
        found = self.low[word] >> shift
        found |= np.where(shift > 0, self.low[word + 1] << ((U8(64) - shift) & U8(63)), U8(0))
        return found & U8((1 << self.width) - 1)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Bitmap position of the ``rank``-th zero."""
        zeros = 64 * np.arange(len(self.ones)) - self.ones
        word = np.searchsorted(zeros, rank, "right") - 1
        return 64 * word + _select_in_word(~self.high[word], (rank - zeros[word]).astype(np.int64))

    def access(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, at, "right") - 1
        place = 64 * word + _select_in_word(self.high[word], (at - self.ones[word]).astype(np.int64))
        return ((place - at).astype(U8) << U8(self.width)) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is not in the sequence: the successor is found, then compared."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        for first in range(0, len(values), SLICE):
            part = values[first:first + SLICE].astype(U8)
            head = (part >> U8(self.width)).astype(np.int64)
            inside = np.flatnonzero(head <= len(self.high) * 64 - self.n - 2)
            head, tail = head[inside], part[inside] & U8((1 << self.width) - 1)
            start = np.where(head > 0, self._zero(np.maximum(head, 1) - 1) + 1 - head, 0)
            end = stop = self._zero(head) - head
            while (start < end).any():  # halve each element range that shares the high part
                middle = (start + end) >> 1
                below = (start < end) & (self._low(np.minimum(middle, self.n - 1)) < tail)
                start, end = np.where(below, middle + 1, start), np.where(below, end, np.minimum(middle, end))
            hit = (start < stop) & (self._low(np.minimum(start, self.n - 1)) == tail)
            out[first + inside[hit]] = start[hit]
        return out


class Trie:
    """The levels of one shard. ``span`` is above every word id."""

    NAMES = ("words", "successors", "first", "before", "pairs", "bases")

    def __init__(self, span: int, levels: dict[str, EliasFano], codes2: np.ndarray, codes3: np.ndarray):
        self.span, self.levels, self.codes2, self.codes3 = span, levels, codes2, codes3

    @classmethod
    def build(cls, middle: np.ndarray, left: np.ndarray, last: np.ndarray, counts: np.ndarray, span: int) -> Trie:
        """From distinct n-grams (left, middle, last) sorted by middle, left, last, with counts above zero."""
        words, word = np.unique(middle, return_inverse=True)
        word = word.astype(U8)
        keys2, at2 = np.unique(word * U8(span) + last.astype(U8), return_inverse=True)
        sums = np.bincount(at2, counts, len(keys2)).astype(np.int64)
        first = np.searchsorted(keys2 // U8(span), np.arange(len(words) + 1)) if len(words) else np.zeros(1, np.int64)
        pairs, pair = np.unique(word * U8(span) + left.astype(U8), return_inverse=True)
        children = np.diff(first)[(pairs // U8(span)).astype(np.int64)] if len(pairs) else np.zeros(0, np.int64)
        bases = np.concatenate([[0], np.cumsum(children)])
        rank = at2 - first[word.astype(np.int64)] if len(word) else at2
        levels = {"words": words, "successors": keys2, "first": first, "before": pairs, "pairs": bases[pair] + rank,
                  "bases": bases}
        order = np.argsort(levels["pairs"], kind="stable")
        levels["pairs"] = levels["pairs"][order]
        return cls(span, {k: EliasFano.build(np.asarray(v)) for k, v in levels.items()}, quantised(sums),
                   quantised(counts[order]))

    def find(self, middle: np.ndarray, left: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the counts of (middle, last) and (left, middle, last), zero where they are not in the trie.

        A left word from ``span`` on is none.
        """
        level = self.levels
        codes2, codes3 = np.zeros(len(middle), np.uint16), np.zeros(len(middle), np.uint16)
        word = level["words"].find(middle)
        known = np.flatnonzero(word >= 0)
        base = word[known].astype(U8) * U8(self.span)
        at = level["successors"].find(base + last[known].astype(U8))
        codes2[known[at >= 0]] = self.codes2[at[at >= 0]]
        pair = level["before"].find(base + left[known].astype(U8))
        both = np.flatnonzero((at >= 0) & (pair >= 0) & (left[known] < self.span))
        for first in range(0, len(both), SLICE):
            part = both[first:first + SLICE]
            rank = at[part] - level["first"].access(word[known[part]]).astype(np.int64)
            found = level["pairs"].find(level["bases"].access(pair[part]) + rank.astype(U8))
            codes3[known[part[found >= 0]]] = self.codes3[found[found >= 0]]
        return codes2, codes3

    def write(self, file) -> None:
        """Arrays one after another, each with its type and length, aligned to eight bytes."""
        arrays = [np.array([self.span], np.int64)]
        for name in self.NAMES:
            x = self.levels[name]
            arrays += [np.array([x.n, x.width], np.int64), x.low, x.high, x.ones]
        for a in [*arrays, self.codes2, self.codes3]:
            file.write(struct.pack("<8sq", a.dtype.str.encode(), a.nbytes))
            file.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        file.flush()

    @classmethod
    def mapped(cls, file) -> Trie:
        """The levels of a written trie, read from a memory map as they are touched."""
        flat, at, arrays = np.memmap(file, np.uint8, "r"), 0, []
        while at < len(flat):
            kind, size = struct.unpack("<8sq", flat[at:at + 16].tobytes())
            arrays.append(flat[at + 16:at + 16 + size].view(np.dtype(kind.rstrip(b"\0").decode())))
            at += 16 + size + -size % 8
        levels = {}
        for k, name in enumerate(cls.NAMES):
            (n, width), low, high, ones = arrays[1 + 4 * k:5 + 4 * k]
            levels[name] = EliasFano(int(n), int(width), low, high, ones)
        return cls(int(arrays[0][0]), levels, arrays[-2], arrays[-1])
