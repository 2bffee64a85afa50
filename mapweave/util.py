"""Shared helpers: tables cut from their lineage, work spread over the cores, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; at most 1/HOT_SHARE keys can be hot.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where the setting is absent, a temporary one, in local mode
    only: on a cluster each executor would write to its own disk, so there its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mapweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written by this process and not removed yet.
_KEPT: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mapweave-{name}-{uuid.uuid4().hex[:12]}"
    _KEPT.add(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.discard(path)


def release(spark: SparkSession) -> int:
    """Remove every table that results of this process are read from, and give their number: to be called when the results
    are written or no longer wanted. Tables an operator has consumed are removed by itself."""
    kept = list(_KEPT)
    for path in kept:
        remove_path(spark, path)
    return len(kept)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path. It is computed once, cuts the
    lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return materialize(df, name)[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over the cores if the scan has fewer partitions than cores (small files); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def absent(c: Column) -> Column:
    """NULL and the empty string both stand for an absent value."""
    return c.isNull() | (c == "")


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row per key with the number of its rows in `size`.

    A key with HOT_SHARE of `total` rows or more never goes through a shuffle: there are at most
    1/HOT_SHARE such keys, so that side is broadcast whatever the size of the data. The rest is an
    ordinary shuffled join in which no key holds more than HOT_SHARE of the rows. `how`: inner or left
    (left keeps rows without a group, null keys included).
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    cold = groups.where(F.col(size) < limit)
    marked = rows.join(hot.select(F.col(key), F.lit(True).alias("_hot")), key, "left")
    first = marked.where(F.col("_hot")).drop("_hot").join(hot, key, "inner")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, key, how)
    return first.unionByName(rest)
