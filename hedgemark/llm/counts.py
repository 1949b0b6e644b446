"""Token counts of a unigram vocabulary without making the tokens.

Per different word, an Aho-Corasick automaton lists all vocabulary pieces inside it, by
their end; dynamic programming over the ends carries the best score and its piece count.
The rules are the tokenizer's own: scores add as 64-bit floats from the left; of equal
scores the piece that begins first stays; a character that is no piece costs ten less than
the least score and counts as its UTF-8 bytes. A text is the sum over its words, each with
the word-begin sign in front.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.llm.common import bounded_batches, text_blocks
from hedgemark.llm.tokens import public_path

BEGIN = "▁"
#: Most words one Python worker remembers before it starts anew.
MEMORY = 800_000
UNKNOWN_PENALTY = 10.0
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter(dict):
    """word -> (pieces, score), filled as words are asked for."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> tuple[int, float]:
        self[word] = found = self.count(BEGIN + word)
        return found

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best split of a whole string."""
        ending: dict[int, list[tuple[int, float]]] = {}
        if self.ready:
            for end, found in self.automaton.iter(text):
                ending.setdefault(end + 1, []).append(found)  # at one end, the longest comes first
        scores, pieces = [0.0], [0]
        for end in range(1, len(text) + 1):
            best, count, single = None, 0, False
            for length, score in ending.get(end, ()):
                single |= length == 1
                total = score + scores[end - length]
                if best is None or total > best:
                    best, count = total, pieces[end - length] + 1
            if not single:
                total = self.unknown + scores[end - 1]
                if best is None or total > best:
                    best, count = total, pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            scores.append(best)
            pieces.append(count)
        return pieces[-1], scores[-1]


_counters: dict[str, Counter] = {}


def _counted(columns: Iterator[pd.Series], path: str) -> Iterator[pd.DataFrame]:
    if path not in _counters:
        _counters[path] = Counter(pieces_of(path))
    counter = _counters[path]
    for texts in columns:
        out = []
        for _, run in text_blocks(texts.tolist()):
            if len(counter) > MEMORY:
                counter.clear()
            for text in run:
                words = text.translate(_SPACES).split(" ")
                found = [counter[w] for w in words if w]
                out.append((len(found), sum([n for n, _ in found]), sum([s for _, s in found])))
        yield pd.DataFrame(out, columns=["n_words", "n_tokens", "score"])


def token_counts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep``, n_words, n_tokens and score (the best splits' scores together), one row per document row.

    Whole texts; null and empty texts have none. No shuffle: rows, repeated or not, are
    counted where they lie. Other columns are dropped first, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = path or public_path("piece_bpe_32k.model")

    def counted(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _counted(columns, vocabulary)

    udf = F.pandas_udf(counted, "n_words bigint, n_tokens bigint, score double")
    return docs.select(F.struct(*keep).alias("doc"), udf(F.col("text")).alias("found")).select("doc.*", "found.*")
