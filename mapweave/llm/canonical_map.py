"""Freely typed values led to the entries of a reference list by symmetric-delete lookups."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mapweave.util import join_by_group, materialize, remove_path, spread

#: Surfaces (terms and synonyms) broadcast at a time; a longer reference list is looked up in blocks.
BLOCK = 20_000
#: Letters of a word that deletes are taken of; more than any number of edits allowed.
PREFIX = 7
#: A segment is a qualifying phrase once it stands beside so many different entries.
PHRASE_ENTRIES = 5
#: Phrases at most; they are shipped with the dictionary.
MOST_PHRASES = 100_000

# Words that carry no meaning of their own in a name.
FILLERS = frozenset(("a", "an", "and", "at", "in", "of", "on", "or", "than", "the", "to", "with"))


def fold(text: str) -> str:
    """Lower case without accents, in compatibility form."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(ch))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def allowed(word: str) -> int:
    """Edits allowed against a word of a name of several words: none to two letters, then more with the length."""
    n = len(word)
    return 0 if n <= 2 else 1 if n == 3 else 2 if n < 8 else 3


def allowed_alone(word: str) -> int:
    """Edits allowed against a name of one word, which nothing else confirms."""
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 5 else 2


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (optimal string alignment) by count, most + 1 for all beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, i, j = 0, len(a), len(b)
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while lo < i and lo < j and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:i], b[lo:j]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = last[j] if x == y else 1 + min(last[j], last[j + 1], row[j])
            if i and j and x == b[j - 1] and a[i - 1] == y and before[j - 1] < best:
                best = before[j - 1] + 1
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment), inf beyond `most`.

    A doubled or halved letter costs 0.6, two swapped neighbours 0.8, anything else 1."""
    if abs(len(a) - len(b)) > most / 0.6:
        return float("inf")
    before: list[float] = []
    last = [0.0]
    for j in range(len(b)):
        last.append(last[-1] + (0.6 if j and b[j] == b[j - 1] else 1.0))
    for i, x in enumerate(a):
        drop = 0.6 if i and x == a[i - 1] else 1.0
        row = [last[0] + drop]
        for j, y in enumerate(b):
            best = min(last[j] + (x != y), last[j + 1] + drop, row[j] + (0.6 if j and y == b[j - 1] else 1.0))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 0.8)
            row.append(best)
        if min(row) > most:
            return float("inf")
        before, last = last, row
    return last[-1] if last[-1] <= most else float("inf")


def deletes(word: str, most: int) -> set[str]:
    """The word's first PREFIX letters with up to `most` of them deleted. Two words within k edits share one of
    these sets' members for k deletes each: what an edit touches is deleted on both sides, and so is what
    is shifted over the border of the prefix."""
    head = word[:PREFIX]
    out = {head}
    for k in range(1, min(most, len(head)) + 1):
        out.update(map("".join, combinations(head, len(head) - k)))
    return out


def _letters(word: str) -> int:
    """A set of letters in 64 bits; an edit changes two of them at most."""
    out = 0
    for ch in word:
        out |= 1 << (ord(ch) & 63)
    return out


class SymmetricDelete:
    """Lookup of all words within their allowed number of edits, by deletes of both sides."""

    def __init__(self, entries: list[str], bound=allowed):
        self.known = set(entries)
        self.index: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
        #: deletes a word of each length needs, by the entries near that length
        self.reach: dict[int, int] = defaultdict(int)
        for w in self.known:
            k = bound(w)
            entry = (w, k, _letters(w))
            for d in deletes(w, k):
                self.index[d].append(entry)
            for n in range(len(w) - k, len(w) + k + 1):
                self.reach[n] = max(self.reach[n], k)

    def find(self, word: str) -> list[tuple[str, float]]:
        """(entry, weighted cost) of the entries within their edits; of an exact entry, that alone."""
        if word in self.known:
            return [(word, 0.0)]
        if len(word) not in self.reach:
            return []
        seen, out, mine = set(), [], _letters(word)
        for d in deletes(word, self.reach[len(word)]):
            for w, k, letters in self.index.get(d, ()):
                if w not in seen:
                    seen.add(w)
                    if (mine ^ letters).bit_count() <= 2 * k and edits(word, w, k) <= k:
                        out.append((w, distance(word, w, float(k))))
        return out


#: Fillers with a typing error.
NEAR_FILLERS = SymmetricDelete([f for f in FILLERS if len(f) > 2], lambda w: 1)


def phrase_edits(phrase: str) -> int:
    """Edits allowed against a qualifying phrase."""
    n = len(phrase)
    return 0 if n < 4 else 1 if n < 7 else 2


class Dictionary:
    """The reference entries of one category, ready for lookup."""

    def __init__(self, surfaces: list[tuple[int, str, float]], phrases: tuple[str, ...] = ()):
        """surfaces: (term_id, name, frequency). phrases: what may stand beside a name without changing it; one
        of which all words stand in the category's names is none there."""
        self.exact: dict[str, tuple[float, int]] = {}
        self.frequency: dict[int, float] = {}
        self.entries: list[tuple[int, list[str], frozenset[str]]] = []
        joined: dict[str, list[int]] = defaultdict(list)
        for term, name, freq in surfaces:
            self.frequency[term] = max(freq, self.frequency.get(term, 0.0))
            w = words(name)
            if not w:
                continue
            key = " ".join(w)
            self.exact[key] = min(self.exact.get(key, (float("inf"), 0)), (-freq, term))
            self.entries.append((term, w, frozenset(w) - FILLERS or frozenset(w)))
            if len("".join(w)) >= 6:
                joined["".join(w)].append(term)
        vocabulary = {w for _, ws, _ in self.entries for w in ws}
        self.phrases = SymmetricDelete([p for p in phrases if not set(p.split()) <= vocabulary], phrase_edits)
        self.qualifies: dict[str, bool] = {}
        self.lookup = SymmetricDelete(sorted(vocabulary))
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for k, (_, _, need) in enumerate(self.entries):
            for w in need:
                self.by_word[w].append(k)
        self.joined = joined
        self.whole = SymmetricDelete(sorted(joined), lambda w: 1 if len(w) < 10 else 2)
        starts: dict[str, set[str]] = defaultdict(set)
        for w in vocabulary:
            for n in range(4, len(w)):
                starts[w[:n]].add(w)
        self.starts = starts
        self.cut_short = SymmetricDelete(sorted(starts), lambda w: 0 if len(w) < 5 else 1)
        self.memo: dict[tuple[str, bool], dict[str, float]] = {}

    def candidates(self, word: str, shortened: bool, known: frozenset[str]) -> dict[str, float]:
        """Reference words the word may be, with their costs. known: words of the value that other blocks of the
        reference have."""
        found = self.memo.get((word, shortened))
        if found is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            found = self.memo[word, shortened] = self._candidates(word, shortened)
        if word in known and word not in self.lookup.known:
            return {w: c for w, c in found.items() if shortened and w.startswith(word)}
        return found

    def _candidates(self, word: str, shortened: bool) -> dict[str, float]:
        found = dict(self.lookup.find(word))
        if shortened and word not in found:
            for s, cost in self.cut_short.find(word):
                for w in self.starts[s]:
                    found[w] = min(found.get(w, float("inf")), cost + 0.3)
        return found

    def best(self, value: str, known: frozenset[str] = frozenset()) -> tuple[int, float, float]:
        """(term_id, cost, frequency), or (0, 0.0, 0.0) for no entry."""
        found = [x for t in self.variants(value) if (x := self._match(t, known))]
        if not found:
            return 0, 0.0, 0.0
        cost, frequency, term = min(found)
        return term, cost, -frequency

    def _qualifier(self, segment: str) -> bool:
        s = phrase_of(segment)
        found = self.qualifies.get(s)
        if found is None:
            if len(self.qualifies) >= 200_000:
                self.qualifies.clear()
            found = self.qualifies[s] = bool(s) and bool(self.phrases.find(s))
        return found

    def variants(self, value: str) -> list[str]:
        """The value as it is, and without the segments that only qualify it."""
        kept = segments(value)
        if len(kept) < 2 or not self.phrases.known:
            return [value]
        drop = [self._qualifier(t) for t, _ in kept]
        if any(drop) and not all(drop):
            return [value, _without(kept, drop)]
        return [value]

    def _match(self, text: str, known: frozenset[str]) -> tuple[float, float, int] | None:
        tokens = re.findall(r"[^\W_]+\.?", fold(text))
        plain = [t.rstrip(".") for t in tokens]
        if not plain:
            return None
        if (hit := self.exact.get(" ".join(plain))) is not None:
            return 0.0, hit[0], hit[1]
        options = []
        for raw, w in zip(tokens, plain):
            c = self.candidates(w, raw.endswith("."), known)
            if w in FILLERS and not c:
                continue
            if not c:
                if w not in FILLERS and not NEAR_FILLERS.find(w):
                    options = None
                    break
                continue
            options.append((w, c))
        best = None
        if options:
            cost_of: dict[str, float] = {}
            for _, c in options:
                for w, x in c.items():
                    cost_of[w] = min(x, cost_of.get(w, float("inf")))
            hits: dict[int, int] = defaultdict(int)
            for w in cost_of:
                for k in self.by_word.get(w, ()):
                    hits[k] += 1
            for k, n in hits.items():
                term, names, need = self.entries[k]
                if n < len(need):
                    continue
                inside = set(names)
                cost, used, order, place = 0.0, set(), 0.0, -1
                for w, c in options:
                    own = [(x, v) for v, x in c.items() if v in inside]
                    if not own:
                        if w in FILLERS:
                            continue
                        break
                    x, v = min(own)
                    cost += x
                    used.add(v)
                    at = names.index(v)
                    order = 0.1 if at < place else order
                    place = at
                else:
                    alone = allowed_alone(min(need)) if len(need) == 1 else 99
                    if need <= used and cost <= min(alone, max(2.0, sum(map(len, plain)) / 5)):
                        key = (cost + order, -self.frequency[term], term)
                        best = key if best is None else min(best, key)
        if best is None and len(s := "".join(plain)) >= 6:
            for w, cost in self.whole.find(s):
                for term in self.joined[w]:
                    key = (cost + 0.2, -self.frequency[term], term)
                    best = key if best is None else min(best, key)
        return best


def segments(value: str) -> list[tuple[str, str]]:
    """(text, the mark behind it) of the segments of a value that have text. They are parted by brackets, `/`,
    `:`, `,`, `;`, `?`, `*`, `=`, and by a dash or a full stop with white space."""
    parts = re.split(r"([\[\](){}/:,;?*=]+|\s[-‐-―]+\s|\.\s)", value)
    out: list[tuple[str, str]] = []
    for t, m in zip(parts[::2], [*parts[1::2], ""]):
        if out and out[-1][1].startswith(".") and t.strip().isdigit():  # "see p. 2": the number goes with its words
            out[-1] = (out[-1][0] + out[-1][1] + t, m)
        elif t.strip():
            out.append((t, m))
    return out


def phrase_of(segment: str) -> str:
    """The words of a segment without numbers: a page or form number goes with the words before it."""
    return " ".join(x for x in words(segment) if not x.isdigit())


def _without(kept: list[tuple[str, str]], drop: list[bool]) -> str:
    return " ".join(t + (m if m.startswith(".") else " ") for (t, m), d in zip(kept, drop) if not d)


def _beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(category, key, phrase): each segment of a value, and the words of the value without it."""
    for frame in frames:
        rows = []
        for c, value in zip(frame["category"], frame["value"]):
            kept = segments(value)
            for k in range(len(kept) if len(kept) > 1 else 0):
                phrase = phrase_of(kept[k][0])
                if phrase:
                    rows.append((c, " ".join(words(_without(kept, [i == k for i in range(len(kept))]))), phrase))
        yield pd.DataFrame(rows, columns=["category", "key", "phrase"])


@F.pandas_udf(StringType())
def _key(names: pd.Series) -> pd.Series:
    return names.map(lambda x: " ".join(words(x)))


def learn_phrases(distinct: DataFrame, names: DataFrame, entries: int = PHRASE_ENTRIES) -> list[str]:
    """Segments that qualify a value and don't name it: those that stand beside the names of at least `entries`
    different entries, the rest of the value being a name word by word. Learnt from all values, joined with the
    names by their words; the phrases themselves are few, and more than MOST_PHRASES are an error."""
    # a value without a mark has one segment
    marked = distinct.where(F.col("value").rlike(r"[\[\](){}/:,;?*=]|[\s\p{Z}][-‐-―]+[\s\p{Z}]|\.[\s\p{Z}]"))
    found = spread(marked).mapInPandas(_beside, "category string, key string, phrase string")
    found = found.join(names.select("category", _key("name").alias("key"), "term_id"), ["category", "key"])
    found = found.groupBy("phrase").agg(F.countDistinct("category", "term_id").alias("n")).where(F.col("n") >= entries)
    rows = found.select("phrase").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} qualifying phrases")
    return sorted(r.phrase for r in rows)


_READY: dict[str, dict] = {}


def _dictionaries(shipped) -> dict:
    """The dictionaries of a block, built once a worker."""
    block, surfaces, phrases = shipped.value
    if block not in _READY:
        _READY.clear()
        by: dict[str, list] = defaultdict(list)
        for c, term, name, f in surfaces:
            by[c].append((term, name, f))
        _READY[block] = {c: Dictionary(s, phrases) for c, s in by.items()}
    return _READY[block]


def map_values(
    values: DataFrame, reference: DataFrame, category: str = "category", value: str = "value", block: int = BLOCK, phrases: list[str] | None = None
) -> DataFrame:
    """(category, value, rows, term_id, cost) for each distinct pair of `values` that is neither NULL nor
    blank: the entry of the same category the value means, and 0 for none.

    reference: term_id, category, term, synonyms. A value means an entry if all the words of one of its names
    stand in it, in any order, each within its allowed number of edits, and no other words but fillers. A word
    ending in a full stop may be cut short, and words may be run together. Segments that only qualify (`-
    confirmed`, `(biopsy)`) don't count: `phrases` are those, with a typing error or two in the longer ones; by
    default they are learnt from the values (learn_phrases), and [] stands for none. A word the reference
    knows is taken as that word only. The cheapest entry by weighted Damerau-Levenshtein distance wins, then the one
    found more often as written in the values, then the smaller term_id. An empty reference or category gives 0.

    Plan: values are counted per distinct value first, so a value with a third of all rows is looked up
    once. The symmetric-delete dictionary is shipped in blocks of `block` names, whatever the length of the
    list, and the best of all blocks taken. The result is a table, so that each value is looked up once
    however often the result is read.
    """
    spark = values.sparkSession
    v = F.col(value).cast("string")
    distinct = values.where(v.isNotNull() & v.rlike(r"[^\s\p{Z}]")).groupBy(F.col(category).alias("category"), v.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    distinct, values_at = materialize(distinct, "values")
    names = reference.select(
        "term_id", F.col(category).alias("category"), F.explode(F.array_union(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name")
    ).where(F.col("name").isNotNull())
    # how often each name stands in the values as written, letter case aside
    seen = distinct.groupBy("category", F.lower(F.trim("value")).alias("_k")).agg(F.sum("rows").alias("f"))
    names = names.withColumn("_k", F.lower(F.trim("name"))).join(seen, ["category", "_k"], "left").fillna(0, ["f"])
    names, names_at = materialize(names.select("category", "term_id", "name", "f"), "names")
    learnt = learn_phrases(distinct, names) if phrases is None else sorted({phrase_of(p) for p in phrases} - {""})
    total = names.count()
    blocks = max(1, -(-total // block))
    asked = spread(distinct)
    known_at = None
    if blocks > 1:
        # by the hash of the entry, so that a block holds whole entries
        names = names.withColumn("_b", F.pmod(F.xxhash64("term_id"), F.lit(blocks)))
        # the words of each value that any block has: elsewhere they are no typing errors
        parted = F.udf(lambda x: sorted(set(words(x))), "array<string>")
        have = names.select("category", F.explode(parted("name")).alias("w")).distinct()
        mine = distinct.select("category", "value", F.explode(parted("value")).alias("w")).join(have, ["category", "w"])
        asked = distinct.join(mine.groupBy("category", "value").agg(F.collect_list("w").alias("known")), ["category", "value"], "left")
        asked, known_at = materialize(asked, "known")
    out = None
    for b in range(blocks):
        mine = names.where(F.col("_b") == b) if blocks > 1 else names
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.category, r.term_id, r.name, float(r.f)) for r in mine.toLocalIterator()], tuple(learnt)))

        def look(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ready = _dictionaries(shipped)
            for frame in frames:
                known = [frozenset(k if k is not None else ()) for k in frame["known"]] if "known" in frame else [frozenset()] * len(frame)
                best = [ready[c].best(x, k) if c in ready else (0, 0.0, 0.0) for c, x, k in zip(frame["category"], frame["value"], known)]
                yield frame[["category", "value", "rows"]].assign(term_id=[t for t, _, _ in best], cost=[c for _, c, _ in best], f=[f for _, _, f in best])

        found = asked.mapInPandas(look, "category string, value string, rows long, term_id long, cost double, f double")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        pick = F.min_by(F.struct("term_id", "cost"), F.struct(F.col("term_id") == 0, "cost", -F.col("f"), "term_id"))
        out = out.groupBy("category", "value").agg(F.first("rows").alias("rows"), pick.alias("b")).select("category", "value", "rows", "b.term_id", "b.cost")
    out, _ = materialize(out.select("category", "value", "rows", "term_id", "cost"), "mapped")
    for at in (values_at, names_at, *([known_at] if known_at else [])):
        remove_path(spark, at)
    return out


def lead_rows(rows: DataFrame, mapped: DataFrame, total: int) -> DataFrame:
    """rows (category, value, ...) with term_id: each row gets its distinct value's entry."""
    key = F.struct("category", "value")
    keyed = rows.withColumn("_v", key).drop("category", "value")
    return join_by_group(keyed, mapped.select(key.alias("_v"), "rows", "term_id"), "_v", "rows", total).drop("rows")


def misses(mapped: DataFrame) -> DataFrame:
    """The values that mean no entry, with the rows that hold them: (category, value, rows)."""
    return mapped.where(F.col("term_id") == 0).select("category", "value", "rows")
