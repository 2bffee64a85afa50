"""Mapping pipelines: stages that each see only what the stages before left open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import calibrate, match
from mapweave.operators.kb import KnowledgeBase, row_rank
from mapweave.util import cut, spread


def exact_stage(kb: KnowledgeBase, columns: DataFrame) -> DataFrame:
    """columns (name) -> the first destination of the first source of that name, confidence 1."""
    hit = kb.lookup(columns.select(F.col("name").alias("term")))
    best = hit.groupBy("term").agg(F.min_by("destination", "dest_ord").alias("target"))
    return best.select(F.col("term").alias("name"), "target", F.lit(1.0).alias("confidence"), F.lit("exact").alias("stage"))


def fuzzy_stage(kb: KnowledgeBase, columns: DataFrame, variants: bool = False, cap: float = 1.0) -> DataFrame:
    """The best fuzzy hit over the gate with a path as target; with variants the name's forms are tried too."""
    asked = columns.select("name", F.explode(tx.query_variants(F.col("name")) if variants else F.array("name")).alias("query"))
    hits = match.fuzzy_destinations(match.fuzzy_lookup(asked, kb.sources.select("source")), kb)
    good = match.gate(hits).join(asked, "query").select("name", "source", "target", "score")
    best = good.groupBy("name").agg(F.min_by(F.struct("target", "score"), F.struct(-F.col("score"), F.col("source"), F.col("target"))).alias("b"))
    return best.select("name", "b.target", F.round(F.least(F.col("b.score"), F.lit(cap)), 3).alias("confidence"), F.lit("fuzzy").alias("stage"))


def vector_stage(kb: KnowledgeBase, columns: DataFrame, least: float = 0.5, top: int = 400, keyed: DataFrame | None = None, matcher: str = "biobert") -> DataFrame:
    """The most similar of the `top` commonest destinations by hashed name vectors, from `least` on. The
    destinations are a list of that fixed length, held by every task. Likenesses count to nine places; equal
    ones go to the first path. With keyed predictions (calibrate.explode_keys) the
    confidence is the accuracy of the matcher's field scores of that likeness, and `least` applies to it."""
    goal = common_destinations(kb, top).select("destination", match.hash_places(F.col("destination")).alias("v")).orderBy("destination").collect()
    targets = [r.destination for r in goal]
    units = match.place_counts(pa.array([r.v for r in goal], pa.list_(pa.int64())))
    size = np.sqrt((units * units).sum(axis=1))
    asked = spread(columns.where(F.col("name").isNotNull()).select("name")).select("name", match.hash_places(F.col("name")).alias("v"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            v = match.place_counts(batch.column(1))
            own = np.sqrt((v * v).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                # cosines come in floating point: a little over 1 lies in no bin
                raw = np.minimum(np.round((v @ units.T) / (own[:, None] * size[None, :]), 9), 1.0)
            raw = np.where(np.isnan(raw), -np.inf, raw)
            best = raw.argmax(axis=1) if len(targets) and len(names) else np.zeros(0, int)
            rows = [(n, targets[k], float(raw[i, k])) for i, (n, k) in enumerate(zip(names, best)) if raw[i, k] > -np.inf]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(3)], ["name", "target", "raw"])

    best = asked.mapInArrow(nearest, "name string, target string, raw double")
    if keyed is None:
        return best.select("name", "target", F.round("raw", 3).alias("confidence"), F.lit("vector").alias("stage")).where(F.col("confidence") >= least)
    best = cut(best, "vectors")
    scores = best.select(F.col("name").alias("id"), F.lit(matcher).alias("matcher"), F.lit("field").alias("tier"), F.lit("").alias("schema"), F.lit("").alias("context"), F.col("raw").alias("confidence"))
    known = calibrate.calibrate_scores(scores, keyed).select(F.col("id").alias("name"), "calibrated").where(F.col("calibrated") >= least)
    return best.join(known, "name").select("name", "target", F.round("calibrated", 3).alias("confidence"), F.lit("vector").alias("stage"))


def common_destinations(kb: KnowledgeBase, top: int = 400) -> DataFrame:
    """(destination, n): the commonest paths, ties by the path."""
    counted = kb.destinations.where(F.col("destination").contains(".")).groupBy("destination").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "destination").limit(top)


def map_columns(kb: KnowledgeBase, columns: DataFrame, vectors: bool = False, keyed: DataFrame | None = None) -> DataFrame:
    """columns (name) -> (name, target, confidence, stage), each name once: exact, fuzzy, optionally by vectors
    (calibrated by keyed predictions where given), else unmapped with NULL target. What a stage left open is written before the next reads it, so each stage
    runs once."""
    names = columns.where(F.col("name").isNotNull()).select("name").distinct()
    done = cut(exact_stage(kb, names), "stage")
    open_ = cut(names.join(done, "name", "left_anti"), "open")
    second = cut(fuzzy_stage(kb, open_), "stage")
    out = done.unionByName(second)
    open_ = open_.join(second, "name", "left_anti")
    if vectors:
        third = cut(vector_stage(kb, open_, keyed=keyed), "stage")
        out, open_ = out.unionByName(third), open_.join(third, "name", "left_anti")
    none = open_.select("name", F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("confidence"), F.lit("unmapped").alias("stage"))
    return out.unionByName(none)


def map_columns_constrained(kb: KnowledgeBase, columns: DataFrame) -> DataFrame:
    """columns (name, candidates) -> as map_columns, with targets among the candidates where those are given;
    fuzzy tries the forms of the name, caps the confidence at 0.9 and compares its best hit only. What stays
    open needs review."""
    asked = columns.select("name", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    fits = (F.size("candidates") == 0) | F.array_contains("candidates", F.col("target"))
    hit = kb.lookup(asked.select(F.col("name").alias("term"))).join(asked, F.col("term") == F.col("name")).withColumn("target", F.col("destination")).where(fits)
    done = hit.groupBy("name").agg(F.min_by("target", "dest_ord").alias("target")).select("name", "target", F.lit(1.0).alias("confidence"), F.lit("exact").alias("stage"))
    done = cut(done, "stage")
    open_ = asked.join(done, "name", "left_anti")
    fuzzy = fuzzy_stage(kb, open_, variants=True, cap=0.9).join(asked, "name").where(fits).drop("candidates")
    rest = open_.join(fuzzy, "name", "left_anti").select("name", F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("confidence"), F.lit("needs_review").alias("stage"))
    return done.unionByName(fuzzy).unionByName(rest)


def run_tiers(matches: DataFrame, weights: dict[str, float], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """matches (source_entity, source_field, target_entity, target_field, tier, embedder_scores, ord): combined
    scores and levels, low ones dropped, the k best of each field, equal pairs once; and the counts of that."""
    m = matches.withColumn("score", match.ensemble(F.col("embedder_scores"), weights)).where(F.col("score").isNotNull())
    m = m.withColumn("level", match.confidence_level(F.col("score"))).where(F.col("level") != "low")
    once = match.dedupe_matches(m, ["source_entity", "source_field", "target_entity", "target_field"])
    acted = row_rank(once, ["source_entity", "source_field"], [F.desc("score"), F.col("ord")]).where(F.col("rank") <= k).withColumn("requires_review", F.col("level") == "medium")
    counts = acted.groupBy("tier").agg(F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "medium").alias("medium"), F.count_if("requires_review").alias("review"))
    return acted, counts


def learn_metrics(matches: DataFrame) -> DataFrame:
    """matches (tier, level, requires_review, user_feedback) -> a row per tier: total, high, medium, low, review,
    feedback_true, feedback_false. NULL feedback is neither."""
    levels = [F.count_if(F.col("level") == k).alias(k) for k in ("high", "medium", "low")]
    return matches.groupBy("tier").agg(
        F.count(F.lit(1)).alias("total"), *levels, F.count_if(F.col("requires_review")).alias("review"),
        F.count_if(F.col("user_feedback")).alias("feedback_true"), F.count_if(~F.col("user_feedback")).alias("feedback_false"),
    )


def coverage(mapped: DataFrame) -> DataFrame:
    """(stage, n, share) by stage, and the share of names with a target in the row `mapped`."""
    g = mapped.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    total = mapped.agg(F.count(F.lit(1)).alias("t"), F.count("target").alias("m"))
    by = g.crossJoin(total).select("stage", "n", F.round(F.try_divide("n", "t"), 6).alias("share"))
    return by.unionByName(total.select(F.lit("mapped").alias("stage"), F.col("m").alias("n"), F.round(F.try_divide("m", "t"), 6).alias("share")))


def verdict(predicted: Column, accept: Column) -> Column:
    """EXACT, FAMILY (same resource, and one path prefixes the other or the first two segments agree), WRONG,
    or UNMAPPED for no prediction."""
    head = F.split_part(predicted, F.lit("."), F.lit(1))

    def family(a: Column) -> Column:
        two = lambda x: F.slice(F.split(x, "[.]"), 1, 2)
        return (F.split_part(a, F.lit("."), F.lit(1)) == head) & (predicted.startswith(F.concat(a, F.lit("."))) | a.startswith(F.concat(predicted, F.lit("."))) | (two(predicted) == two(a)))

    none = predicted.isNull() | predicted.isin("", "—", "None")
    return F.when(none, "UNMAPPED").when(F.array_contains(accept, predicted), "EXACT").when(F.exists(accept, family), "FAMILY").otherwise("WRONG")


def eval_report(judged: DataFrame) -> DataFrame:
    """judged (stratum, verdict) -> a row per stratum and one for ALL: counts, and the usable share."""
    kinds = ("EXACT", "FAMILY", "WRONG", "UNMAPPED")
    g = judged.rollup("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("verdict") == k).alias(k.lower()) for k in kinds))
    return g.select(F.coalesce("stratum", F.lit("ALL")).alias("stratum"), "n", *(k.lower() for k in kinds), F.round((F.col("exact") + F.col("family")) / F.col("n"), 6).alias("usable"))
