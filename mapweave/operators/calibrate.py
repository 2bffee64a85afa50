"""Confidence calibration by binned accuracy per key, with backoff from specific to general keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.util import cut, join_by_group

BINS = 10
#: A key is eligible with so many positives and so many predictions.
MIN_POSITIVE, MIN_TOTAL = 100, 300
#: Matchers of one calibration run at most.
MOST_MATCHERS = 1000


def key_chain(matcher: Column, tier: Column, schema: Column, context: Column) -> Column:
    """Keys of a prediction from specific to general: five with wildcards, then `matcher:tier`, then `matcher`.
    Levels whose parts are absent repeat the next more general one and fall together."""

    def part(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", "*").otherwise(c)

    t, s, c = part(tier), part(schema), part(context)
    star = F.lit("*")
    five = [F.concat_ws(":", matcher, *x) for x in ((t, s, c), (t, s, star), (t, star, c), (t, star, star), (star, star, star))]
    legacy = F.when(t != "*", F.concat_ws(":", matcher, t))
    return F.array_distinct(F.array_compact(F.array(*five, legacy, matcher)))


def bin_of(confidence: Column) -> Column:
    """Bin read for a score: the tenth it lies in, 1.0 in the last; NULL outside of (-0.1, 1]."""
    b = (confidence * F.lit(10.0)).cast("int")
    return F.when((confidence >= 0.0) & (confidence <= 1.0), F.least(b, F.lit(BINS - 1))).when((confidence > -0.1) & (confidence < 0.0), 0)


def build_bin(confidence: Column, compat: bool = False) -> Column:
    """Bin a prediction is counted in. compat compares with multiples of 0.1 in floating point, which puts
    0.3, 0.6 and 0.7 one bin lower than bin_of reads them; by default both agree."""
    if not compat:
        return F.when((confidence >= 0.0) & (confidence <= 1.0), bin_of(confidence))
    out = None
    for i in range(BINS):
        inside = (confidence >= F.lit(i * 0.1)) & ((confidence < F.lit((i + 1) * 0.1)) if i < BINS - 1 else (confidence <= 1.0))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def explode_keys(predictions: DataFrame) -> DataFrame:
    """predictions (matcher, tier, schema, context, confidence, correct) -> a row per distinct key of each."""
    keys = key_chain(*(F.col(c) for c in ("matcher", "tier", "schema", "context")))
    return predictions.select(F.explode(keys).alias("key"), F.col("confidence").cast("double").alias("confidence"), F.col("correct").cast("int").alias("correct"))


def key_stats(keyed: DataFrame) -> DataFrame:
    g = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_total"), F.sum("correct").alias("n_pos"))
    return g.withColumn("eligible", (F.col("n_pos") >= MIN_POSITIVE) & (F.col("n_total") >= MIN_TOTAL))


def curves(keyed: DataFrame, compat: bool = False) -> DataFrame:
    """(key, bin, lo, hi, mean_conf, accuracy, n): ten bins a key; an empty bin has its middle as mean
    confidence and accuracy 0. Confidences outside of 0..1 are in no bin."""
    got = keyed.withColumn("bin", build_bin(F.col("confidence"), compat)).where(F.col("bin").isNotNull())
    got = got.groupBy("key", "bin").agg(F.avg("confidence").alias("mean_conf"), F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    grid = keyed.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    lo, hi = F.col("bin") / 10.0, (F.col("bin") + 1) / 10.0
    return grid.join(got, ["key", "bin"], "left").select(
        "key", "bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("mean_conf", (lo + hi) / 2).alias("mean_conf"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n")
    )


def interpret(ece: Column) -> Column:
    return F.when(ece < 0.05, "well calibrated").when(ece < 0.15, "moderately calibrated").otherwise("poorly calibrated")


def ece(keyed: DataFrame, compat: bool = False) -> DataFrame:
    """(key, n, accuracy, mean_conf, ece, verdict); n counts predictions outside of all bins too."""
    totals = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.avg("correct").alias("accuracy"), F.avg("confidence").alias("mean_conf"))
    gaps = curves(keyed, compat).groupBy("key").agg(F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))).alias("gap"))
    out = totals.join(gaps, "key").select("key", F.col("total").alias("n"), "accuracy", "mean_conf", (F.col("gap") / F.col("total")).alias("ece"))
    return out.withColumn("verdict", interpret(F.col("ece")))


def report(keyed: DataFrame, top: int | None = None) -> DataFrame:
    """key_stats with each key's matcher and its rank among the matcher's keys, the largest first; the `top` largest."""
    w = Window.partitionBy("matcher").orderBy(F.desc("n_total"), "key")
    out = key_stats(keyed).withColumn("matcher", F.split_part("key", F.lit(":"), F.lit(1))).withColumn("rank", F.row_number().over(w)).orderBy(F.desc("n_total"), "key")
    return out.limit(top) if top is not None else out


def calibrate_scores(scores: DataFrame, keyed: DataFrame, compat: bool = False) -> DataFrame:
    """scores (id, matcher, tier, schema, context, confidence) -> (id, confidence, key_used, calibrated).

    The accuracy of the score's bin at the first eligible key of its chain, else at the most general key there
    is, else the score itself; also the score itself where it lies in no bin.
    """
    stats = key_stats(keyed).select("key", "eligible")
    table = curves(keyed, compat).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "accuracy"))).alias("curve"))
    known = stats.join(table, "key")
    chain = cut(scores, "scores").select("id", "confidence", F.posexplode(key_chain(*(F.col(c) for c in ("matcher", "tier", "schema", "context")))).alias("level", "key"))
    # the general keys of a matcher hold all its scores
    sized = chain.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).join(known, "key")
    hit = join_by_group(chain, sized, "key", "_n", chain.count())
    b = bin_of(F.col("confidence"))
    value = F.try_element_at("curve", b)
    picked = hit.withColumn("value", value).groupBy("id").agg(
        F.min_by(F.when(F.col("eligible"), F.struct("key", "value")), F.when(F.col("eligible"), F.col("level"))).alias("first"), F.max_by(F.struct("key", "value"), F.col("level")).alias("last")
    )
    out = scores.select("id", "confidence").join(picked, "id", "left").withColumn("p", F.coalesce("first", "last"))
    return out.select("id", "confidence", F.col("p.key").alias("key_used"), F.coalesce("p.value", "confidence").alias("calibrated"))


def rank_metrics(ranked: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """ranked (query, rank of the right answer or NULL) -> P@1, R@k, MRR within k, and F1 of the first two."""
    hit = F.col("rank") <= k
    g = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("p_at_1"),
        F.avg(F.coalesce(hit.cast("double"), F.lit(0.0))).alias("r_at_k"),
        F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p_at_1") * F.col("r_at_k"), F.col("p_at_1") + F.col("r_at_k")), F.lit(0.0)))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two summaries (matcher, tier, accuracy, ece) side by side with their differences."""
    x, y = (df.select("matcher", "tier", *(F.col(c).alias(f"{c}_{s}") for c in ("accuracy", "ece"))) for df, s in ((a, "no"), (b, "yes")))
    j = x.join(y, ["matcher", "tier"])
    return j.withColumn("accuracy_delta", F.col("accuracy_yes") - F.col("accuracy_no")).withColumn("ece_delta", F.col("ece_yes") - F.col("ece_no"))


def hash_split(df: DataFrame, key: str, parts: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, the test part one in `parts`."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts))
    return df.where(h != 0), df.where(h == 0)


def top1_outcomes(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions (id, target, score, ord) against truth (id, target): whether each id's best is a true
    target, letter case aside: (id, target, score, correct)."""
    best = predictions.groupBy("id").agg(F.max_by(F.struct("target", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b")).select("id", "b.*")
    right = truth.select("id", F.lower("target").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    return best.withColumn("_t", F.lower("target")).join(right, ["id", "_t"], "left").select("id", "target", "score", F.coalesce("_hit", F.lit(False)).alias("correct"))


def build(predictions: DataFrame, truth: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calibrators of several matchers on several tiers at once, with their summary.

    predictions (matcher, tier, id, target, score, ord) against truth (tier, id, target): the best prediction of each
    matcher and id is right if it is a true target (top1_outcomes). Returns the outcomes (matcher, tier, id, target, score,
    correct), the curves of each `matcher:tier` and `matcher`, and the summary (matcher, tier, n, accuracy, mean_conf,
    ece), with tier `global` for all tiers of a matcher. Scores outside of 0..1 count and lie in no bin.
    """
    key = F.struct("matcher", "tier", "id").alias("id")
    matchers = [r.matcher for r in predictions.select("matcher").where(F.col("matcher").isNotNull()).distinct().limit(MOST_MATCHERS + 1).collect()]
    if len(matchers) > MOST_MATCHERS:
        raise ValueError(f"more than {MOST_MATCHERS} matchers")
    right = truth.withColumn("matcher", F.explode(F.array(*map(F.lit, matchers)) if matchers else F.array().cast("array<string>"))).select(key, "target")
    best = top1_outcomes(predictions.select(key, "target", "score", "ord"), right).select("id.*", "target", "score", "correct")
    keyed = best.select(F.explode(F.array(F.concat_ws(":", "matcher", "tier"), F.col("matcher"))).alias("key"), F.col("score").cast("double").alias("confidence"), F.col("correct").cast("int").alias("correct"))
    summary = ece(keyed, compat).select(
        F.split_part("key", F.lit(":"), F.lit(1)).alias("matcher"),
        F.when(F.col("key").contains(":"), F.split_part("key", F.lit(":"), F.lit(2))).otherwise("global").alias("tier"),
        "n", "accuracy", "mean_conf", "ece",
    )
    return best, curves(keyed, compat), summary


def save_curves(table: DataFrame, summary: DataFrame, path: str) -> None:
    """Curves as Parquet, the summary as CSV with a header."""
    table.write.mode("overwrite").parquet(f"{path}/curves")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def open_curves(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    kinds = "matcher string, tier string, n long, accuracy double, mean_conf double, ece double"
    return spark.read.parquet(f"{path}/curves"), spark.read.schema(kinds).option("header", True).csv(f"{path}/summary")
