"""Incremental feedback statistics, calibration and usage counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators import calibrate
from mapweave.operators.feedback import DECISIONS
from mapweave.util import remove_path, scratch_path


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_stats(feedback: DataFrame) -> DataFrame:
    """Counts by matcher, tier and decision; use with output mode complete or update."""
    word = F.lower(F.trim("decision"))
    return feedback.where(word.isin(*DECISIONS)).groupBy("matcher", "tier", word.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def windowed_decisions(feedback: DataFrame, at: str = "decided_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Decisions per event-time window; a window comes out once the watermark has passed it."""
    word = F.lower(F.trim("decision"))
    timed = feedback.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), word.alias("decision")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "decision", "n")


def calibration_state(predictions: DataFrame) -> DataFrame:
    """Additive state per key and bin: (key, bin, n, sum_conf, sum_correct)."""
    keyed = calibrate.explode_keys(predictions).withColumn("bin", calibrate.build_bin(F.col("confidence")))
    return keyed.where(F.col("bin").isNotNull()).groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum_conf"), F.sum("correct").alias("sum_correct"))


def merge_state(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's state under its own number, so a batch that is run again overwrites
    itself and counts once. read_state adds the batches up."""

    def merge(batch: DataFrame, number: int) -> None:
        calibration_state(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def read_state(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.parquet(path)
    g = s.groupBy("key", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "sum_conf", "sum_correct")))
    return g.select("key", "bin", "n", (F.col("sum_conf") / F.col("n")).alias("mean_conf"), (F.col("sum_correct") / F.col("n")).alias("accuracy"))


def run_available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a query over what is there now and give its result, a table in the shared folder: in mode append what all batches gave, in mode
    complete what the last one gave. The checkpoint is kept in the shared folder too and removed afterwards, unless one
    is named. A batch that is run again overwrites itself."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    at = checkpoint or scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(path if mode == "complete" else f"{path}/batch=-1")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    if not checkpoint:
        remove_path(spark, at)
    return spark.read.schema(stream.schema).parquet(path)


def merge_usage(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over records (ord, resource, json): counts of paths under the batch's number, as in
    merge_state."""
    from mapweave.operators import fhir

    def merge(batch: DataFrame, number: int) -> None:
        nodes = fhir.walk(fhir.parse_records(batch), ("ord", "resource"))
        fhir.field_usage(nodes).select("path", "n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("path").agg(F.sum("n").alias("n"))
