"""Sizes and boundaries in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
import re
from operator import itemgetter

import numpy as np

#: Where the vocabulary lies on every machine; a parameter of all operators that count tokens.
DEFAULT_VOCABULARY = os.environ.get("MAPWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the published split pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces up to this length are remembered, and so many of them.
MEMO_CHARS, MEMO_SIZE = 48, 400_000
#: Set in a token's character count if the token starts within a character.
INSIDE = 0x8000

_UNEVEN = re.compile(r" \s|\s ")
_SPLIT = re.compile(r" (?=\S)")


def _even(text: str) -> bool:
    """Whether every space stands between two non-spaces, or starts the text."""
    if text.isascii() and "\t" not in text and "\r" not in text:
        return not ("  " in text or "\n " in text or " \n" in text or text[-1:] == " " or any(c in text for c in "\v\f\x1c\x1d\x1e\x1f"))
    return not _UNEVEN.search(text) and text[-1:] != " "


def pieces(text: str) -> list[str]:
    """The text parted at each space that a non-space follows, without these spaces. The split pattern never
    reaches over such a place, so each piece, with its space before it, is encoded on its own."""
    return text.split(" ") if _even(text) else _SPLIT.split(text)


def _look_up(memo: dict, keys: list[str]) -> tuple:
    return itemgetter(*keys)(memo) if len(keys) > 1 else (memo[keys[0]],) if keys else ()


class _Memo(dict):
    def __init__(self, make, prefix: str):
        super().__init__()
        self.make, self.prefix = make, prefix

    def __missing__(self, piece: str):
        value = self.make(self.prefix + piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[piece] = value
        return value


class Tokens:
    """Counts and token boundaries, with the pieces of text seen before remembered."""

    _open: dict[str, Tokens] = {}

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("mapweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # characters begun by each token, marked if it starts within one
        self.chars = np.zeros(max(ranks.values()) + 1, np.uint16)
        for b, k in ranks.items():
            self.chars[k] = sum((x & 0xC0) != 0x80 for x in b) | (INSIDE if (b[0] & 0xC0) == 0x80 else 0)
        count = lambda s: len(self.encoding.encode_ordinary(s))
        self._first, self._rest = _Memo(count, ""), _Memo(count, " ")
        self._first_chars, self._rest_chars = _Memo(self._chars_of, ""), _Memo(self._chars_of, " ")

    @classmethod
    def of(cls, vocabulary: str) -> Tokens:
        """One instance per process and vocabulary."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def _chars_of(self, s: str) -> bytes:
        return self.chars[self.encoding.encode_ordinary(s)].tobytes()

    def short(self, text: str) -> int:
        """Tokens of a word or a run of white space."""
        return self._first[text]

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = pieces(text)
        return (self._first[first] if first else 0) + sum(_look_up(self._rest, rest))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character offset before each token and after the last, and whether the text can be cut there
        (False within a character)."""
        if not text:
            return np.zeros(1, np.int64), np.ones(1, bool)
        first, *rest = pieces(text)
        packed = (self._first_chars[first] if first else b"") + b"".join(_look_up(self._rest_chars, rest))
        each = np.frombuffer(packed, np.uint16)
        offsets = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each & (INSIDE - 1), out=offsets[1:])
        clean = np.ones(len(each) + 1, bool)
        clean[:-1] = each < INSIDE
        return offsets, clean
