"""Held-out texts leaking into a corpus, found by spaced seeds."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.util import spread

MIN_WORDS = 12
WORDS_PER_EDIT = 6
#: Documents whose words go through the seeds at a time.
TOGETHER = 500
#: Items whose seeds are broadcast at a time; more items are searched in blocks.
BLOCK_ITEMS = 20_000
# The masks, as (words before the ignored position, words after it). Together with five words in
# a row they hit every passage of 12 words with up to two words replaced, dropped or added.
MASKS = ((4, 2), (3, 3), (2, 4))
RUN = 5

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCTUATION = string.punctuation.encode() + bytes([*range(9), 14, 15, *range(16, 28), 127])
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_SPACES = re.compile(r"\\[nrt]")
_NO_WORD = re.compile(r"[^\w\s]|_")


def text_words(text: str) -> list[bytes]:
    """The words of a text, parted by white space, without what leaking may change: letter case, punctuation,
    markup, escapes, Unicode form, accents. Words of nothing but punctuation vanish."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = _SPACES.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = _NO_WORD.sub("", unicodedata.normalize("NFKD", text).lower())
        return text.encode("utf-8", "replace").split()
    return text.encode().translate(_LOWER, _PUNCTUATION).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for c in columns:
        h = _mix(h * np.uint64(0x100000001B3) + c)
    return h


def _windows(ids: np.ndarray, before: int, gap: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the windows all of whose unmasked words are known (> 0), and their hashes."""
    span = before + gap + after
    if len(ids) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    offsets = [*range(before), *range(before + gap, span)]
    known = ids > 0
    n = len(ids) - span + 1
    ok = known[:n].copy()
    for o in offsets[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    u = ids.astype(np.uint64)
    return at, _hash([u[at + o] for o in offsets]) if len(at) else np.zeros(0, np.uint64)


class Seeds:
    """The seeds of a block of items: hash -> (item, position, words before the gap, gap, words after)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list = []
        self.vocabulary: dict[bytes, int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text_words(text)]
            self.items.append((item, np.array(ids, np.int64)))
        self.run = self._table([(RUN, 0, 0)])
        # against a masked word of the document: the same mask (replaced), or no gap (added)
        self.gapped = {m: self._table([(m[0], 1, m[1]), (m[0], 0, m[1])]) for m in MASKS}
        # against six words in a row of the document: an item's mask (dropped)
        self.whole = self._table([(m[0], 1, m[1]) for m in MASKS])
        self.items = [(item, ids.tolist()) for item, ids in self.items]

    def _table(self, shapes: list[tuple[int, int, int]]):
        keys, rows = [], []
        for k, (_, ids) in enumerate(self.items):
            for b, g, a in shapes:
                at, h = _windows(ids, b, g, a)
                keys.append(h)
                rows.append(np.stack([np.full(len(at), k), at, np.full(len(at), b), np.full(len(at), g), np.full(len(at), a)], axis=1))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        rows = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        bits = np.zeros(1 << 22, bool)
        bits[keys >> np.uint64(42)] = True
        return keys, rows, bits

    @staticmethod
    def probe(table, at: np.ndarray, h: np.ndarray):
        """(document position, seed) of all hits."""
        keys, rows, bits = table
        if not len(keys) or not len(h):
            return
        maybe = np.flatnonzero(bits[h >> np.uint64(42)])
        at, h = at[maybe], h[maybe]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        for k in np.flatnonzero(hi > lo):
            for r in rows[lo[k] : hi[k]]:
                yield int(at[k]), r

    def hits(self, doc: np.ndarray):
        """(item index, item position, document position, words before, item gap, document gap, words after)."""
        at, h = _windows(doc, RUN, 0, 0)
        for j, (k, p, b, g, a) in self.probe(self.run, at, h):
            yield int(k), int(p), j, RUN, 0, 0, 0
        at, h = _windows(doc, 6, 0, 0)
        for j, (k, p, b, g, a) in self.probe(self.whole, at, h):
            yield int(k), int(p), j, int(b), int(g), 0, int(a)
        for m in MASKS:
            at, h = _windows(doc, m[0], 1, m[1])
            for j, (k, p, b, g, a) in self.probe(self.gapped[m], at, h):
                yield int(k), int(p), j, int(b), int(g), 1, int(a)


def reaches(a: list[int], i: int, b: list[int], j: int, step: int, most: int) -> list[int]:
    """For e = 0, 1, ... edits: how many words of `a` from i on (in direction step) an alignment with `b` from
    j on can cover. Furthest-reaching points per diagonal; it ends when the words are used up."""
    na = len(a) - i if step > 0 else i + 1
    nb = len(b) - j if step > 0 else j + 1

    def slide(x: int, d: int) -> int:
        y = x + d
        while x < na and y < nb and a[i + step * x] == b[j + step * y]:
            x, y = x + 1, y + 1
        return x

    far = {0: slide(0, 0)}
    out = [far[0]]
    for e in range(1, most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            # replaced: both move; dropped from b: a moves; added to b: b moves
            x = max(far.get(d, -9) + 1, far.get(d + 1, -9) + 1, far.get(d - 1, -9))
            if x < 0:
                continue
            x = min(x, na)
            if x + d < 0 or x + d > nb:
                x = min(x, nb - d)
                if x < 0 or x + d < 0:
                    continue
            new[d] = slide(x, d)
        far = new
        if not far:
            break
        out.append(max(max(far.values()), out[-1]))
        if out[-1] >= na:
            break
    return out


def longest(item: list[int], p: int, doc: list[int], j: int, before: int, gap_i: int, gap_d: int, after: int) -> int:
    """Words of the longest passage of the item around a seed that the document holds with at most one word in
    WORDS_PER_EDIT edited; 0 if no such passage has MIN_WORDS."""
    inside, edits = before + gap_i + after, max(gap_i, gap_d)
    # A passage has its matching words and at most one word for each edit. Matching words are words of the item that
    # the document has on that side, as far as a passage can reach: with so many of them, more edits than this
    # can't be paid for.
    reach = len(item) // WORDS_PER_EDIT + 2
    beyond, behind = p + inside, j + before + gap_d + after
    known = set(doc[max(0, j - p - reach) : j])
    matching = inside + sum([w in known for w in item[:p]])
    known = set(doc[behind : behind + len(item) - beyond + reach])
    matching += sum([w in known for w in item[beyond:]])
    most = (matching - WORDS_PER_EDIT * edits) // (WORDS_PER_EDIT - 1)
    if most < 0 or matching + most < MIN_WORDS:
        return 0
    left = reaches(item, p - 1, doc, j - 1, -1, most) if p and j else [0] + [min(k + 1, p) for k in range(2)]
    q, r = p + inside, j + before + gap_d + after
    right = reaches(item, q, doc, r, 1, most) if q < len(item) and r < len(doc) else [0] + [min(k + 1, len(item) - q) for k in range(2)]
    best = 0
    for x, l in enumerate(left):
        for y, r_ in enumerate(right):
            n = inside + l + r_
            if n > best and n >= MIN_WORDS and n >= WORDS_PER_EDIT * (x + y + edits):
                best = n
    return best


def leaked_items(seeds: Seeds, texts: list[str]) -> list[dict[int, int]]:
    """For each text: item index -> words of its longest leaked passage. The texts' words go through the
    seeds together, parted by an unknown word, which no window with known words can hold unmasked."""
    get = seeds.vocabulary.get
    ids: list[int] = []
    starts = [0]
    for t in texts:
        ids.extend([get(w, 0) for w in text_words(t)])
        ids.extend((0, 0))
        starts.append(len(ids))
    doc = np.array(ids, np.int64)
    found: list[dict[int, int]] = [{} for _ in texts]
    spans: dict[tuple[int, int], int] = {}
    bounds = np.array(starts[1:])
    for k, p, j, b, gi, gd, a in seeds.hits(doc):
        # hits further along the same diagonal of a run already verified bring nothing new
        if j < spans.get((k, j - p), -1):
            continue
        item = seeds.items[k][1]
        if gi == gd == 0:
            end, d = j + RUN, j - p
            while end - d < len(item) and ids[end] == item[end - d]:
                end += 1
            spans[k, d] = end - RUN + 1
        n = longest(item, p, ids, j, b, gi, gd, a)
        if n:
            at = int(np.searchsorted(bounds, j, "right"))
            found[at][k] = max(found[at].get(k, 0), n)
    return found


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, words): each document and item where the document holds a passage of at least
    MIN_WORDS successive words of the item, one word in WORDS_PER_EDIT replaced, dropped or added at most;
    `words` is the length of the longest such passage. Edited words at the ends of a passage count as part
    of it, as they may be replaced ones.

    Words are text_words. Whole texts are searched. NULL and empty texts and items under MIN_WORDS words match
    nothing; repeated items and documents each count. Empty tables give no rows; further columns are ignored.

    Plan: the items' seeds are broadcast, in blocks of `block` items (the documents are read once a block);
    the documents are scanned where they lie, without a shuffle. Hashes of words with one position masked
    join both sides; each hit is verified by extension in both directions with the fewest edits.
    """
    spark = documents.sparkSession
    given = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("_i"), F.col(item_text).alias("_t"))
    total = given.count()
    blocks = max(1, -(-total // block))
    docs = spread(documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")))
    out = None
    for k in range(blocks):
        mine = given if blocks == 1 else given.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == k)
        shipped = spark.sparkContext.broadcast([(r._i, r._t) for r in mine.toLocalIterator()])

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(shipped.value)
            numbers = [n for n, _ in seeds.items]
            for batch in batches:
                rows: list[tuple[int, int, int]] = []
                for lo in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(lo, TOGETHER)
                    for doc, found in zip(part.column(0).to_pylist(), leaked_items(seeds, part.column(1).to_pylist())):
                        rows.extend((doc, numbers[i], n) for i, n in found.items())
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], ["doc_id", "item_id", "words"])

        found = docs.mapInArrow(search, "doc_id long, item_id long, words long")
        out = found if out is None else out.unionByName(found)
    return out
