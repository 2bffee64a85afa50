"""Matchers: rules, fuzzy names, vectors; ranking and combination of their scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import tee
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import profile as profiles
from mapweave.operators.kb import KnowledgeBase
from mapweave.util import materialize, remove_path, spread

#: Acceptance of a fuzzy match.
FUZZY_GATE = 0.55
#: Letters of a contained name by which pairs are found.
HEAD = 12
#: Queries compared at a time with all rows.
QUERY_BLOCK = 4096
#: Grams whose places a task keeps (under 100 MB).
GRAMS_KEPT = 500_000
#: Names whose heads are broadcast (under 100 MB); more are joined by shuffle.
MOST_HEADS = 1_000_000


class Matcher(Protocol):
    """Scores of names against paths, in 0..1. Pairs that aren't there score 0."""

    def score(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """sources (source), targets (target) -> (source, target, score)."""


def gate(scored: DataFrame, least: float = FUZZY_GATE) -> DataFrame:
    """Fuzzy hits good enough to propose: the score, and a target that is a path."""
    return scored.where((F.col("score") >= F.lit(least)) & F.col("target").contains("."))


def within_resources(targets: DataFrame, resources: list[str]) -> DataFrame:
    """Targets that are one of the resources or lie in one."""
    return targets.where(F.split_part("target", F.lit("."), F.lit(1)).isin(*resources))


def confidence_level(score: Column, high: float = 0.95, medium: float = 0.85) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def route(score: Column, high: float = 0.95, medium: float = 0.85) -> Column:
    return F.when(score >= high, "AUTO-ACCEPT").when(score >= medium, "HITL REVIEW").otherwise("REJECT")


def rule_hits(kb: KnowledgeBase, asked: DataFrame, goal: DataFrame, tier: str | None = None) -> DataFrame:
    """asked (term, distinct) x goal (target, distinct, ord) -> (term, target, t_ord, score) of pairs scoring above zero."""
    m = kb.mappings()
    known = m.where(F.col("tier") == tier) if tier else m
    by_rule = asked.join(known, F.col("term") == F.col("source")).select("term", F.lower("destination").alias("path")).distinct()
    content = asked.join(by_rule.select("term").distinct(), "term", "left_anti")
    by_value = content.join(kb.values.select("id", "source_value"), F.lower("term") == F.lower("source_value")).join(kb.targets, F.col("id") == F.col("content_value_id"))
    paths = by_rule.unionByName(by_value.select("term", F.lower("fhir_path").alias("path")).distinct())

    goal = goal.select("target", F.col("ord").alias("t_ord"), F.lower("target").alias("_t"))
    exact = paths.join(goal, F.col("path") == F.col("_t")).select("term", "target", "t_ord", F.lit(1.0).alias("score"))
    bare = goal.where(~F.col("target").contains("."))
    resource = paths.select("term", F.split_part("path", F.lit("."), F.lit(1)).alias("res")).distinct().join(bare, F.col("res") == F.col("_t"))
    return exact.unionByName(resource.select("term", "target", "t_ord", F.lit(0.5).alias("score")))


def rule_match(kb: KnowledgeBase, terms: DataFrame, targets: DataFrame, k: int = 5, tier: str | None = None) -> DataFrame:
    """terms (term) x targets (target, ord) -> (term, target, score, rank), the k best of each term.

    A target that is a destination of the term (letter case aside) scores 1.0, a target that is only a
    resource of one 0.5, any other 0.0; equal scores keep the targets' order. Terms without a mapping of the
    tier are scored by the coded values of that name instead.

    Pairs are not formed: targets scoring above zero come from equi-joins, and only the first k targets can
    fill the places below them.
    """
    asked = terms.select("term").distinct()
    goal = targets.groupBy("target").agg(F.min("ord").alias("ord"))
    hits = rule_hits(kb, asked, goal, tier)
    goal = goal.withColumnRenamed("ord", "t_ord")
    filler = F.broadcast(goal.orderBy("t_ord").limit(k).select("target", "t_ord", F.lit(0.0).alias("score")))
    every = hits.unionByName(asked.crossJoin(filler))
    best = every.groupBy("term", "target", "t_ord").agg(F.max("score").alias("score"))
    w = Window.partitionBy("term").orderBy(F.desc("score"), "t_ord")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("term", "target", "score", "rank")


def rule_match_metadata(kb: KnowledgeBase, terms: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that are destinations of the term, with system, code and references of the first such
    destination: (term, target, score, dest_system, dest_code, subject_ref, focus_ref)."""
    asked = terms.select("term").distinct()
    hit = asked.join(kb.mappings(), F.col("term") == F.col("source")).withColumn("_p", F.lower("destination"))
    meta = hit.groupBy("term", "_p").agg(F.min_by(F.struct("dest_system", "dest_code", "subject_ref", "focus_ref"), "dest_ord").alias("m"))
    goal = targets.select("target").distinct()
    return meta.join(goal, F.col("_p") == F.lower("target")).select("term", "target", F.lit(1.0).alias("score"), "m.*")


def fuzzy_lookup(queries: DataFrame, terms: DataFrame, least: float = FUZZY_GATE) -> DataFrame:
    """queries (query) x terms (source) -> (query, source, score) with score >= least, for least > 0.5.

    Every rule of fuzzy_score that can reach such a score lets the pair share a key: the first HEAD letters
    (or all, if fewer) of the contained name or stem stand in the other; or, for shared words, one of the
    words that sort first (of two word sets that overlap by least / 0.6, fewer than 12 words: the whole set).
    So pairs come from equi-joins of these keys instead of a cross join, with the same result. (Up to 0.5
    the common-subsequence rule counts too, which has no such key: see fuzzy_search.)
    """
    if least <= 0.5:
        raise ValueError("scores up to 0.5 need fuzzy_search")
    q, q_at = materialize(queries.select("query").where(F.length("query") > 0).distinct(), "queries")
    s, s_at = materialize(terms.select("source").where(F.length("source") >= 3).distinct(), "names")
    q, s = spread(q), spread(s)

    def heads(c: Column) -> Column:
        return F.array_distinct(F.array(F.left(F.lower(c), F.lit(HEAD)), F.left(tx.stem(c), F.lit(HEAD))))

    share = F.lit(least / 0.6)

    def words(c: Column) -> Column:
        t = F.array_sort(tx.tokens(c))
        n = F.size(t)
        head = F.slice(t, F.lit(1), F.greatest(n - F.ceil(n * share).cast("int") + 1, F.lit(1)))
        return F.when(n > 11, head).when(n > 0, F.array(F.array_join(t, " "))) if least / 0.6 > 11 / 12 - 1e-9 else head

    def contained(short: DataFrame, x: str, long: DataFrame, y: str) -> DataFrame:
        """Pairs of which x stands in y, or the stem of x in that of y, found by a head of x."""
        keys = short.select(x, F.lower(x).alias("_x"), tx.stem(F.col(x)).alias("_xs"), F.explode(heads(F.col(x))).alias("_k")).where(F.length("_k") > 0)
        lengths = sorted(r.n for r in keys.select(F.length("_k").alias("n")).distinct().collect())  # HEAD at most
        few = keys.limit(MOST_HEADS + 1).count() <= MOST_HEADS
        low = F.lower(F.col(y))

        def of_length(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))

        parts = F.array_distinct(F.flatten(F.array(*map(of_length, lengths or [1]))))
        # keys are many times the rows their size is guessed from, so that side is never to be broadcast
        inside = long.select(y, low.alias("_y"), tx.stem(F.col(y)).alias("_ys"), F.explode(parts).alias("_k"))
        found = inside.join(F.broadcast(keys), "_k") if few else inside.hint("merge").join(keys, "_k")
        return found.where(F.col("_y").contains(F.col("_x")) | F.col("_ys").contains(F.col("_xs"))).select("query", "source")

    def pairs(x: Column, y: Column) -> DataFrame:
        return q.withColumn("_k", F.explode(x)).join(s.withColumn("_k", F.explode(y)).hint("merge"), "_k").select("query", "source")

    a, b = F.col("query"), F.col("source")
    both = contained(q, "query", s, "source").unionByName(contained(s, "source", q, "query")).unionByName(pairs(words(a), words(b))).distinct()
    found, _ = materialize(both.withColumn("score", tx.fuzzy_score(a, b, ratio=False)).where(F.col("score") >= F.lit(least)), "pairs")
    for at in (q_at, s_at):
        remove_path(found.sparkSession, at)
    return found


def _subsequence(masks: dict[str, int], full: int, text: str) -> int:
    """Length of the longest common subsequence with the text whose letters' places are in `masks`, by words of
    bits: a zero bit of v is a place where it grows."""
    v = full
    for ch in text:
        m = masks.get(ch)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_count() - v.bit_count()


def _name_parts(name: str) -> tuple[str, str, frozenset[str]]:
    low = name.lower()
    cut = next((len(x) for x in tx.SUFFIXES if low.endswith(x) and len(low) > len(x) + 2), 0)
    words = re.sub("([a-z])([A-Z])", r"\1_\2", name).lower().split("_")
    return low, low[: len(low) - cut], frozenset(w for w in words if len(w) >= 3)


def fuzzy_search(queries: DataFrame, terms: DataFrame, limit: int | None = 10, least: float = 0.3) -> DataFrame:
    """queries (query) x terms (source) -> (query, source, score, rank): the `limit` best by fuzzy_score of at
    least `least` (> 0), all rules included, ties by source; every one for limit None.

    Queries are a stated set, compared in blocks of QUERY_BLOCK with all terms where they lie, each block a pass over them; a
    partition keeps `limit` of each query, so what is shuffled doesn't grow with the terms. Before a common subsequence
    is sought, the letters two names share must be enough for it. NULL and empty names match nothing; repeated
    ones count once.
    """
    if least <= 0:
        raise ValueError("a score of 0 or less is no likeness")
    spark = terms.sparkSession
    asked = queries.select("query").where(F.length("query") > 0).distinct()
    names = terms.select("source").where(F.length("source") >= 3).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for k in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        shipped = spark.sparkContext.broadcast([r["query"] for r in part.collect()])

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            best: dict[str, list[tuple[float, str]]] = {}
            for batch in batches:
                found = batch.column(0).to_pylist()
                parts = [_name_parts(x) for x in found]
                size = np.array([len(p[0]) for p in parts], np.int64)
                letters = _letters([p[0] for p in parts])
                for query in shipped.value:
                    q, qs, qt = _name_parts(query)
                    n = len(q)
                    shared = np.minimum(letters, _letters([q])).sum(axis=1, dtype=np.int64)
                    near = (200.0 * shared / (size + n) >= 69.0).tolist()
                    masks: dict[str, int] = {}
                    for i, ch in enumerate(q):
                        masks[ch] = masks.get(ch, 0) | 1 << i
                    mine = best.setdefault(query, [])
                    for x, (s, ss, st), maybe in zip(found, parts, near):
                        if s == q:
                            score = 1.0
                        elif q in s:
                            score = n / len(s)
                        elif s in q:
                            score = len(s) / n * 0.8
                        elif qs in ss:
                            score = 0.7
                        elif ss in qs:
                            score = 0.65
                        elif not qt.isdisjoint(st):
                            score = 0.6 * len(qt & st) / max(len(qt), len(st))
                        elif maybe:
                            common = 200.0 * _subsequence(masks, (1 << n) - 1, s) / (n + len(s))
                            score = int(common + 0.5) / 100.0
                            score = score * 0.5 if score >= 0.7 else 0.0
                        else:
                            continue
                        score = round(score, 9)  # so that equal shares are equal whatever rule gave them
                        if score >= least:
                            mine.append((-score, x))
                    if limit is not None and len(mine) > 4 * limit:
                        best[query] = sorted(mine, key=lambda h: (h[0], h[1].encode()))[:limit]
            rows = [(query, x, -score) for query, hits in best.items() for score, x in (sorted(hits, key=lambda h: (h[0], h[1].encode()))[:limit] if limit is not None else hits)]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(3)], ["query", "source", "score"])

        hits = spread(names).mapInArrow(search, "query string, source string, score double")
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "source")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit) if limit is not None else ranked


def _letters(names: list[str]) -> np.ndarray:
    """How often each of 64 classes of letters stands in each name: what two names share by classes is no less than
    what they share by letters."""
    out = np.zeros((len(names), 64), np.uint16)
    for k, name in enumerate(names):
        codes, n = np.unique(np.frombuffer(name.encode("utf-32-le"), np.uint32) & 63, return_counts=True)
        out[k, codes] = np.minimum(n, 65_535)
    return out


def fuzzy_lookup_block(queries: list[str], terms: DataFrame, least: float = 0.3) -> DataFrame:
    """(query, source, score) of all pairs for a list of queries, by all rules."""
    q = terms.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(queries)], "query string")
    return fuzzy_search(q, terms, None, least).drop("rank")


def fuzzy_destinations(hits: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """The destinations of fuzzily found names: (query, source, target, score), each pair of name and
    destination once."""
    m = kb.mappings().select("source", F.col("destination").alias("target")).distinct()
    return hits.join(m, "source").select("query", "source", "target", "score")


def unit_vectors(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors, and which rows are usable (one length, no NULL, not zero)."""
    lists = batch.to_pylist()
    dim = max((len(v) for v in lists if v), default=0)
    ok = np.array([v is not None and len(v) == dim and dim > 0 and None not in v for v in lists], bool)
    m = np.array([v if o else [0.0] * dim for v, o in zip(lists, ok)], np.float64).reshape(len(lists), dim)
    norm = np.sqrt((m * m).sum(axis=1))
    ok &= norm > 0
    return m / np.where(norm > 0, norm, 1)[:, None], ok


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k rows most like each query by cosine, itself excepted, ties by id.

    Queries are a stated set, shipped in blocks of QUERY_BLOCK; each partition of the rows keeps k candidates
    a query, so what is shuffled does not grow with the rows. Unusable vectors (NULL, zero, other length) match
    nothing. Exact.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector).alias("v"))
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    data = rows.select(F.col(id_col).cast("long").alias("i"), F.col(vector).alias("v"))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        got = part.toArrow()
        qm, ok = unit_vectors(got["v"].combine_chunks())
        shipped = spark.sparkContext.broadcast((got["i"].to_numpy()[ok], qm[ok]))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            best_s = np.full((len(ids), 0), -np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                m, good = unit_vectors(batch.column(1))
                if m.shape[1] != q.shape[1] or not good.any():
                    continue
                own = batch.column(0).to_numpy()[good]
                s = q @ m[good].T
                s[ids[:, None] == own[None, :]] = -np.inf
                all_s = np.concatenate([best_s, s], axis=1)
                all_i = np.concatenate([best_i, np.broadcast_to(own, s.shape)], axis=1)
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            n = best_s.shape[1]
            keep = (best_s > -np.inf).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[keep]), pa.array(best_i.ravel()[keep]), pa.array(best_s.ravel()[keep])], ["query_id", "id", "similarity"])

        found = data.mapInArrow(search, "query_id long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, for pairs that a join has already formed."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hash_places(c: Column, dims: int = 64, n: int = 3) -> Column:
    """Places of a text's character n-grams among `dims`, by their hashes."""
    padded = F.concat(F.lit("#"), F.lower(c), F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.transform(grams, lambda g: F.pmod(F.conv(F.left(F.md5(g), F.lit(8)), 16, 10).cast("bigint"), F.lit(dims)))


def hash_embedding(c: Column, dims: int = 64, n: int = 3) -> Column:
    """A vector of hashed character n-grams: the embedder where no model is at hand."""
    places = hash_places(c, dims, n)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("float"))


def place_counts(places: pa.Array, dims: int = 64) -> np.ndarray:
    """The vectors of hash_embedding from hash_places, a row each."""
    offsets = places.offsets.to_numpy()
    rows = np.repeat(np.arange(len(places)), np.diff(offsets))
    at = places.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(rows * dims + at, minlength=len(places) * dims).reshape(len(places), dims).astype(np.float64)


class GramPlaces(dict):
    """The places of hash_places by gram, each hashed once: for texts in Python."""

    def __init__(self, dims: int = 64, n: int = 3) -> None:
        self.dims, self.n = dims, n

    def __missing__(self, gram: str) -> int:
        self[gram] = place = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % self.dims
        return place

    def of(self, lowered: list[str]) -> pa.Array:
        """The places of each text, given in small letters (as Spark makes them)."""
        if len(self) > GRAMS_KEPT:
            self.clear()
        places, ends, n = [], [0], self.n
        for text in lowered:
            p = f"#{text}#"
            places += [self[p[i : i + n]] for i in range(max(len(p) - n + 1, 1))]
            ends.append(len(places))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64()))


def nearest_names(names: DataFrame, goals: DataFrame, n: int = 3, dims: int = 64) -> DataFrame:
    """names (tier, id) x goals (tier, target, ord) -> (tier, id, target, score, ord): the goal of the tier most like each name by
    hashed n-grams, cosines to nine places, ties by ord. Goals are a list of up to QUERY_BLOCK entries held by every task;
    more are an error. A tier without goals gives no rows."""
    held = goals.select("tier", "target", "ord", hash_places(F.col("target"), dims, n).alias("p")).orderBy("tier", "ord", "target").limit(QUERY_BLOCK + 1).collect()
    if len(held) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} targets")
    by: dict[str, tuple[list, np.ndarray]] = {}
    for tier in {r.tier for r in held}:
        mine = [r for r in held if r.tier == tier]
        v = place_counts(pa.array([r.p for r in mine], pa.list_(pa.int64())), dims)
        by[tier] = ([(r.target, r.ord) for r in mine], v / np.sqrt((v * v).sum(axis=1))[:, None])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiers, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            v = place_counts(batch.column(2), dims)
            rows = []
            for tier, (targets, units) in by.items():
                mine = [k for k, t in enumerate(tiers) if t == tier]
                s = np.minimum(np.round(v[mine] @ units.T / np.sqrt((v[mine] ** 2).sum(axis=1))[:, None], 9), 1.0)
                rows += [(tier, ids[k], targets[j][0], float(s[i, j]), targets[j][1]) for i, (k, j) in enumerate(zip(mine, s.argmax(axis=1)))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["tier", "id", "target", "score", "ord"])

    asked = spread(names.select("tier", "id")).select("tier", "id", hash_places(F.col("id"), dims, n).alias("p"))
    return asked.mapInArrow(near, "tier string, id string, target string, score double, ord long")


def expert_match(kb: KnowledgeBase, terms: DataFrame, targets: DataFrame) -> DataFrame:
    """terms known to the base: (term, target, score 1.0) for their paths among the targets; a term it
    doesn't know has a row with NULL target, so that a fallback can take over."""
    known = kb.expertise().select(F.col("term").alias("_t"), F.explode("paths").alias("path"))
    asked = terms.select("term").distinct()
    hit = asked.join(known, F.lower("term") == F.col("_t"), "left")
    named = hit.join(targets.select("target").distinct(), F.col("path") == F.col("target"), "left")
    return named.where(F.col("path").isNull() | F.col("target").isNotNull()).select("term", "target", F.when(F.col("target").isNotNull(), 1.0).alias("score")).distinct()


def ensemble(scores: Column, weights: dict[str, float]) -> Column:
    """Weighted mean of a map of scores by embedder; an embedder without a weight counts 1."""
    entries = F.map_entries(scores)
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
    weight = (lambda k: F.coalesce(F.try_element_at(w, k), F.lit(1.0))) if weights else (lambda k: F.lit(1.0))
    up = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]) * e["value"])
    down = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]))
    return F.try_divide(up, down)


def top_k(matches: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dedupe_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Of equal pairs the one of the most specific tier (content, field, entity), then of the higher score,
    then the first. Combines before its shuffle."""
    prio = F.when(F.col("tier") == "content", 0).when(F.col("tier") == "field", 1).when(F.col("tier") == "entity", 2).otherwise(3)
    rest = [c for c in matches.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(prio, -F.coalesce("score", F.lit(-1.0)), F.col("ord")))
    return matches.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def match_tables(left: DataFrame, right: DataFrame, dims: int = 64, one_to_one: bool = True) -> DataFrame:
    """(source, target, score) of the columns of two tables by the likeness of their names and values: of each
    column the ten that sort first in all rows.

    Tables have columns, not rows, to compare: the profiles are two small lists. With one_to_one each column
    is used once, greedily by score, then by names.
    """

    def profile(df: DataFrame) -> list[tuple[str, list[float]]]:
        given = profiles.unpivot(df).where(F.col("value") != "").select("column_name", "value").distinct()
        sample = top_k(given, ["column_name"], 10, [F.col("value")]).orderBy("column_name", "rank").collect()
        texts = [(c, f"{c} {c}: " + ", ".join(r.value for r in sample if r.column_name == c)) for c in df.columns]
        spark = df.sparkSession
        got = spark.createDataFrame(texts, "name string, text string").withColumn("v", hash_embedding(F.col("text"), dims))
        return [(r.name, r.v) for r in got.orderBy("name").collect()]

    spark = left.sparkSession
    a, b = profile(left), profile(right)
    am, bm = (np.array([v for _, v in x], float).reshape(len(x), -1) for x in (a, b))
    norm = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-12)[:, None]
    s = norm(am) @ norm(bm).T if len(a) and len(b) else np.zeros((len(a), len(b)))
    ranked = sorted(((-s[i, j], x, y) for i, (x, _) in enumerate(a) for j, (y, _) in enumerate(b)))
    out, used = [], (set(), set())
    for score, x, y in ranked:
        if not one_to_one or (x not in used[0] and y not in used[1]):
            out.append((x, y, float(-score)))
            used[0].add(x)
            used[1].add(y)
    return spark.createDataFrame(out, "source string, target string, score double")


def _asked(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("source").alias("term")).where(F.col("term").isNotNull()).distinct()


@dataclass(frozen=True)
class RuleMatcher:
    """1 for a known destination of the name, 0.5 for its resource."""

    kb: KnowledgeBase
    tier: str | None = None

    def score(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        goals = targets.select("target").distinct().withColumn("ord", F.xxhash64("target"))
        found = rule_hits(self.kb, _asked(sources), goals, self.tier)
        return found.groupBy(F.col("term").alias("source"), "target").agg(F.max("score").alias("score"))


@dataclass(frozen=True)
class FuzzyMatcher:
    """The best fuzzy score among the known names that lead to the target."""

    kb: KnowledgeBase
    least: float = FUZZY_GATE

    def score(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        asked = _asked(sources).withColumnRenamed("term", "query")
        found = fuzzy_destinations(fuzzy_lookup(asked, self.kb.sources.select("source"), self.least), self.kb)
        found = found.join(targets.select("target").distinct(), "target", "left_semi")
        return found.groupBy(F.col("query").alias("source"), "target").agg(F.max("score").alias("score"))


@dataclass(frozen=True)
class ExpertMatcher:
    """1 for a path the base has for the name, and a fallback matcher for names it doesn't know."""

    kb: KnowledgeBase
    fallback: Matcher | None = None

    def score(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        found = expert_match(self.kb, _asked(sources), targets)
        known = found.where("target IS NOT NULL").select(F.col("term").alias("source"), "target", "score")
        if self.fallback is None:
            return known
        return known.unionByName(self.fallback.score(found.where("target IS NULL").select(F.col("term").alias("source")), targets))


@dataclass(frozen=True)
class VectorMatcher:
    """Cosine of the vectors of names and paths, negative ones as 0: hashed n-grams, or what `model` makes of batches of texts (it is
    called once a partition and maps an iterator of lists of texts to an iterator of lists of vectors)."""

    model: Callable[[Iterator[list[str]]], Iterator[list[list[float]]]] | None = None
    dims: int = 64
    targets_at_most: int = QUERY_BLOCK

    def vectors(self, texts: DataFrame, column: str) -> DataFrame:
        """texts (column) -> (column, v)."""
        if self.model is None:
            return texts.select(column, hash_embedding(F.col(column), self.dims).alias("v"))
        model = self.model

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = tee(batches)
            for batch, vectors in zip(first, model(b.column(0).to_pylist() for b in second)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], [column, "v"])

        return texts.select(column).mapInArrow(embed, f"`{column}` string, v array<double>")

    def score(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """Targets are a stated list, of targets_at_most entries; more are an error."""
        goals = targets.select("target").where(F.col("target").isNotNull()).distinct()
        if goals.limit(self.targets_at_most + 1).count() > self.targets_at_most:
            raise ValueError(f"more than {self.targets_at_most} targets")
        a = self.vectors(_asked(sources).withColumnRenamed("term", "source"), "source")
        b = self.vectors(goals, "target").withColumnRenamed("v", "w")
        pairs = a.crossJoin(F.broadcast(b)).withColumn("score", F.greatest(F.least(cosine(F.col("v"), F.col("w")), F.lit(1.0)), F.lit(0.0)))
        return pairs.where(F.col("score").isNotNull()).select("source", "target", "score")
