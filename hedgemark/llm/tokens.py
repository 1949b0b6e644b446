"""Public tokenizers inside tasks: ids of whole texts as little-endian 32-bit numbers in bytes.

The ids are those of the tokenizers library; tests hold every text against it. Two things
make that cheap. Vocabularies that drop white space see each word for itself, so different
words are encoded once and remembered. Byte-level vocabularies have a twin file of ranks,
which a faster library merges to the same ids; it is used for texts of common Latin
characters, where both libraries' character classes are beyond doubt. All other words and
texts take the tokenizers library's own full path.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Most words one Python worker remembers anew before it forgets those it has not met since the last time.
MEMORY = 700_000


def public_path(name: str) -> str:
    """Where the installed vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\x21-\x7e{LETTERS}]+").fullmatch
#: Anything but printable ASCII, line feeds and Latin characters up to U+024F.
UNCOMMON = re.compile("[^\x20-\x7e\n¡-¬®-ɏ]").search
SEPARATORS = re.compile("[\x1c-\x1f]").search
#: How byte-level vocabularies split a text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that byte-level vocabularies write as another character: those without a visible one, from U+0100 on.
BYTE_SIGNS = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class _Encoder:
    """Ids of texts by the tokenizer as it is: a text that holds an added token's string is always encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # a lower-casing vocabulary may know them by any case
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)", re.I).search

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.whole, texts))


class SpacedBytes(_Encoder):
    """Byte-level vocabularies. ``path`` names the tokenizer's file, its ranks lie beside it as ``.tiktoken``."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        made = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.merge = made.encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.whole(t) if UNCOMMON(t) or self.added(t) else array("I", self.merge(t)).tobytes() for t in texts]


class BareWords(_Encoder):
    """Lower-casing vocabularies that drop white space: every word stands for itself.

    A word of ASCII and Latin-1 letters goes straight to the tokenizer's merges, piece by
    piece. The information separators U+001C to U+001F are white space to Python, but not
    to the tokenizer, so texts with one are encoded whole.
    """

    pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.merge = self.tokenizer.model.tokenize
        self.known = _Words(self, {})
        self.merged: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if not PLAIN(word):
            return self.whole(word)
        word, merged = word.lower(), self.merged
        pieces = (word,) if word.isascii() and word.isalpha() else self.pieces.findall(word)
        for piece in pieces:
            if piece not in merged:
                signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_SIGNS)
                merged[piece] = array("I", [t.id for t in self.merge(signs)]).tobytes()
        return merged[word] if len(pieces) == 1 else b"".join([merged[p] for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known, self.merged = _Words(self, dict(self.known)), {}
        get = self.known.__getitem__
        return [self.whole(t) if SEPARATORS(t) or self.added(t) else b"".join(map(get, t.split())) for t in texts]


class _Words(dict):
    """Ids by word, filled as words are asked for; ``before`` are those remembered earlier."""

    def __init__(self, encoder: BareWords, before: dict[str, bytes]):
        super().__init__()
        self.word, self.before = encoder.word, before

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.word(word)
        self[word] = found
        return found


_encoders: dict[tuple[type, str], _Encoder] = {}


def encoder(kind: type[_Encoder], path: str) -> _Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = (kind, path)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]
