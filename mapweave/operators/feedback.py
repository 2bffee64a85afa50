"""Reviewers' feedback: recording, statistics, and what can be learnt from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("accept", "reject", "correct")
FEEDBACK_SCHEMA = (
    "id bigint, match_id string, source string, source_context string, proposed_target string, ground_truth string, decision string, matcher string, tier string, "
    "confidence double, decided_at timestamp_ntz, user_id string, notes string"
)


def clean(feedback: DataFrame) -> DataFrame:
    """Decisions spelled one way; rows sent again (one id) once, the last delivered; unknown decisions drop out."""
    word = F.lower(F.trim("decision"))
    one = feedback.withColumn("decision", word).where(word.isin(*DECISIONS) & F.col("id").isNotNull())
    rest = [c for c in one.columns if c != "id"]
    last = one.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "ord")).alias("r"))
    return last.select("id", "r.*")


def record(rows: DataFrame, path: str) -> None:
    """Append to the store; a decision that is none of DECISIONS fails the write."""
    ok = F.assert_true(F.col("decision").isin(*DECISIONS), F.concat(F.lit("decision: "), F.coalesce("decision", F.lit("NULL"))))
    rows.where(ok.isNull()).write.mode("append").parquet(path)


def recent(feedback: DataFrame, n: int) -> DataFrame:
    """The newest n, ties by id downwards."""
    return feedback.orderBy(F.desc("decided_at"), F.desc("id")).limit(n)


def stats(feedback: DataFrame) -> DataFrame:
    """(grouping, matcher, tier, decision, n): by decision, matcher and decision, tier and decision, and in
    total, in one pass."""
    g = feedback.groupingSets([["decision"], ["matcher", "decision"], ["tier", "decision"], []], "matcher", "tier", "decision").agg(F.grouping_id("matcher", "tier", "decision").alias("g"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") == 7, "total").when(F.col("g") == 6, "decision").when(F.col("g") == 2, "matcher").otherwise("tier")
    return g.select(name.alias("grouping"), "matcher", "tier", "decision", "n")


def to_calibration(feedback: DataFrame) -> DataFrame:
    """Predictions for calibration: an accepted proposal was correct."""
    ok = F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("matcher").isNotNull()
    return feedback.where(ok).select(
        "matcher", "tier", F.lit("").alias("schema"), F.coalesce("source_context", F.lit("")).alias("context"), "confidence", (F.col("decision") == "accept").alias("correct")
    )


def new_mappings(feedback: DataFrame) -> DataFrame:
    """(source, source_context, destination, tier, n): accepted targets and the paths of corrections."""
    path: Column = F.when(F.col("decision") == "accept", F.coalesce(F.nullif("ground_truth", F.lit("")), "proposed_target")).when(F.col("decision") == "correct", F.nullif("ground_truth", F.lit("")))
    return feedback.withColumn("destination", path).where(F.col("destination").isNotNull()).groupBy("source", "source_context", "destination", "tier").agg(F.count(F.lit(1)).alias("n"))


def consensus_vote(proposals: DataFrame, n: int = 3) -> DataFrame:
    """proposals (item, target, voter, confidence) -> the n targets of each item with most votes, then higher
    mean confidence (to nine places, so that the order of summation decides no tie): (item, target, votes,
    mean_confidence, rank)."""
    from mapweave.operators.kb import row_rank

    g = proposals.groupBy("item", "target").agg(F.countDistinct("voter").alias("votes"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))
    return row_rank(g, ["item"], [F.desc("votes"), F.desc("mean_confidence"), F.col("target")]).where(F.col("rank") <= n)
