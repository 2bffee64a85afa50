"""Oversized texts cut into pieces at their strongest boundaries, by range-maximum queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.tokens import DEFAULT_VOCABULARY, Tokens
from mapweave.util import spread

# Boundary strengths.
INSIDE, TOKEN, WORD, SENTENCE, LINE, PARAGRAPH, HEADING = range(7)
KINDS = ("character", "token", "word", "sentence", "line", "paragraph", "heading")
OUT_BYTES = 8 << 20

# Abbreviations whose full stop ends no sentence; single letters never do.
ABBREVIATIONS = frozenset((
    "Abb", "Bd", "Dr", "Fig", "Mr", "Mrs", "Ms", "Nr", "Prof", "St", "Tab", "al", "approx", "bzw", "ca", "cf", "dr", "env", "etc",
    "ex", "fig", "no", "nr", "núm", "op", "pp", "resp", "sog", "usw", "vgl", "vol", "vs",
))
_ENDS = re.compile(r"(?:[.!?…](?=[\"')\]»”’]*\s)[\"')\]»”’]*|[。！？][」』”）]*)")
_HEADING = re.compile(r"^#{1,6}[ \t]+\S", re.M)
_SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[_SPACES] = True
_CLOSING = np.zeros(128, bool)
_CLOSING[[ord(c) for c in "\"')]"]] = True


def _abbreviated(text: str, dot: int) -> bool:
    """Whether the word before a full stop is an abbreviation or a single letter."""
    word = text[max(0, dot - 8) : dot].split()[-1:] or [""]
    word = word[0].lstrip("([\"'«„“").rpartition(".")[2]
    return len(word) <= 1 and word.isalpha() or word in ABBREVIATIONS


def _sentence_ends(text: str, codes: np.ndarray, space: np.ndarray) -> list[int]:
    if len(codes) < 2:
        return []
    if not text.isascii():
        return [m.end() for m in _ENDS.finditer(text) if m[0][0] != "." or not _abbreviated(text, m.start())]
    at = np.flatnonzero((codes == 46) | (codes == 33) | (codes == 63))
    end = at + 1
    for _ in range(3):  # closing quotes and brackets
        inside = end < len(codes)
        end = end + (inside & _CLOSING[codes[np.minimum(end, len(codes) - 1)]])
    ok = (end < len(codes)) & space[np.minimum(end, len(codes) - 1)]
    stop = codes[at[ok]] == 46
    return [e for e, a, s in zip(end[ok].tolist(), at[ok].tolist(), stop.tolist()) if not s or not _abbreviated(text, a)]


def strengths(text: str) -> np.ndarray:
    """How good a cut before each character, and after the last, is."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        space = _IS_SPACE[codes]
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _IS_SPACE[np.minimum(codes, 0x3001)]
    s = np.full(len(codes) + 1, TOKEN, np.uint8)
    s[:-1][space] = WORD
    s[1:][space] = WORD
    s[_sentence_ends(text, codes, space)] = SENTENCE
    lines = np.flatnonzero(codes == 10)
    if len(lines):
        s[lines + 1] = LINE
        # a line of white space alone: no other character since the line break before
        written = np.cumsum(~space)
        s[lines[1:][written[lines[1:]] == written[lines[:-1]]] + 1] = PARAGRAPH
    if "#" in text:
        for m in _HEADING.finditer(text):
            s[m.start()] = HEADING
    return s


class RangeMaximum:
    """Sparse table over keys; the maximum of a range in two look-ups. The key holds the strength above the
    position, so that of equal strengths the rightmost wins."""

    def __init__(self, strength: np.ndarray, longest: int):
        level = (strength.astype(np.int64) << 40) | np.arange(len(strength))
        self.levels = [level]
        width = 1
        while 2 * width <= min(longest, len(strength)):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in lo..hi."""
        k = (hi - lo + 1).bit_length() - 1
        top = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return top >> 40, top & ((1 << 40) - 1)


def cut(text: str, tokens: Tokens, settings: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """(setting, piece number, start, end, tokens, shared tokens, strength of the cut at the end) of each
    piece of the text under each (setting, max_tokens, overlap_tokens)."""
    offsets, clean = tokens.boundaries(text)
    n = len(offsets) - 1
    over = [m for _, m, _ in settings if n > m]
    if over:
        s = np.where(clean, strengths(text)[offsets], INSIDE)
        table = RangeMaximum(s, max(over) + 1)

    def size_of(start: int, end: int) -> int:
        """Tokens of the piece encoded on its own. Between white space and anything else encoding starts anew,
        but for a space, which goes with the word after it; there the piece's tokens are the text's. Only
        white space at the end of a piece, and words cut in two, are encoded again."""
        p, q = int(offsets[start]), int(offsets[end])
        if start and (text[p - 1].isspace() == text[p].isspace() or text[p - 1] == " "):
            return tokens.count(text[p:q])
        if end == n or not text[q - 1].isspace() and text[q].isspace():
            return end - start
        if text[q].isspace() or text[q - 1] in " \x1c\x1d\x1e\x1f":
            return tokens.count(text[p:q])
        if not text[q - 2 : q - 1].isspace():
            return end - start
        r = q - 1
        while r > p and text[r - 1].isspace():
            r -= 1
        return end - start - tokens.short(text[r : q - 1]) - tokens.short(text[q - 1]) + tokens.short(text[r:q])

    for name, most, overlap in settings:
        if n <= most:
            yield name, 0, 0, len(text), n, 0, HEADING
            continue
        start, shared, number = 0, 0, 0
        while True:
            lo, hi = start + max(overlap + 1, (most + 1) // 2), min(start + most, n)
            before = n + 1
            while True:
                if hi == n and n - start <= most:
                    strength, end = HEADING, n
                else:
                    if lo > hi:
                        lo = min(start + overlap + 1, hi)
                    strength, end = table.best(min(lo, hi), hi)
                    first = start + max(overlap, shared) + 1
                    if strength < SENTENCE and first < lo:
                        # no end of a sentence or more in the upper half: one before it goes before a word or token
                        earlier = table.best(first, lo - 1)
                        if earlier[0] >= SENTENCE:
                            strength, end = earlier
                    if strength == INSIDE:
                        # only tiny limits come here: the nearest cut before, else the first one after
                        end = next((k for k in range(hi, start + overlap, -1) if clean[k]), 0) or next(k for k in range(hi + 1, n + 1) if clean[k])
                        strength = TOKEN
                size = size_of(start, end)
                if size <= most or end >= before:
                    break
                # a word cut in two can take more tokens than its parts had: end earlier, while that helps
                before, hi = end, end - max(1, size - most)
                if hi <= start + overlap:
                    break
            yield name, number, int(offsets[start]), int(offsets[end]), size, shared, strength
            if end == n:
                break
            back = end - overlap
            while back > start and not clean[back]:
                back -= 1
            back = back if back > start else end
            start, shared, number = back, end - back, number + 1


_OUT = pa.schema([
    ("setting", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()),
    ("tokens", pa.int64()), ("overlap_tokens", pa.int64()), ("cut_at", pa.string()), ("text", pa.string()),
])


def split_texts(documents: DataFrame, settings: list[tuple[str, int, int]], doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(setting, doc_id, piece, start_char, end_char, tokens, overlap_tokens, cut_at, text): the pieces of
    each text under each (setting, max_tokens, overlap_tokens).

    A piece has at most max_tokens tokens, counted by encoding the piece itself. It ends at the strongest
    boundary - heading, paragraph, line, sentence, word, token - between half of max_tokens and max_tokens,
    the rightmost of the strongest; if that is a word or token, at the strongest heading, paragraph, line or
    sentence before the half, where there is one past the overlap. The next piece starts overlap_tokens of the
    text's tokens before that end (a token or two earlier if that lies within a character). Pieces of a text, less what each shares
    with the one before, are the text. A text within the limit is one piece. cut_at names the boundary at
    the end, `end` for the last piece.

    NULL texts give no piece, empty texts one empty piece. A character of more tokens than max_tokens is one
    piece, the only kind over the limit. Repeated texts, and texts of repeated ids, are each cut. Columns may
    have any names. Settings need max_tokens >= 1 and 0 <= overlap_tokens < max_tokens; else ValueError.

    Plan: one scan without a shuffle; a text is encoded once for all settings; pieces leave in batches of
    OUT_BYTES.
    """
    for name, most, overlap in settings:
        if most < 1 or not 0 <= overlap < most:
            raise ValueError(f"setting {name}: max_tokens {most}, overlap_tokens {overlap}")
    settings = [(str(a), int(b), int(c)) for a, b, c in settings]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(vocabulary)
        columns: list[list] = [[] for _ in _OUT]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal columns, held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)
            columns, held = [[] for _ in _OUT], 0
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                doc, whole = ids[r].as_py(), texts[r].as_py()
                for name, number, a, b, size, shared, strength in cut(whole, tokens, settings):
                    part = whole[a:b]
                    for c, v in zip(columns, (name, doc, number, a, b, size, shared, "end" if b == len(whole) else KINDS[strength], part)):
                        c.append(v)
                    held += len(part) + 80
                if held >= OUT_BYTES:
                    yield flush()
        if held:
            yield flush()

    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = "setting string, doc_id long, piece long, start_char long, end_char long, tokens long, overlap_tokens long, cut_at string, text string"
    return spread(docs).mapInArrow(split, kinds)


def split_report(pieces: DataFrame) -> DataFrame:
    """Per setting: documents, pieces, largest piece, shared tokens, and where the cuts fell."""
    cuts = [F.count_if(F.col("cut_at") == k).alias(f"cut_{k}") for k in KINDS[1:]]
    return pieces.groupBy("setting").agg(
        F.count_if(F.col("piece") == 0).alias("documents"), F.count(F.lit(1)).alias("pieces"), F.max("tokens").alias("largest"),
        F.sum("tokens").alias("tokens"), F.sum("overlap_tokens").alias("shared_tokens"), *cuts,
    )
