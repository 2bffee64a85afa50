"""Session settings used by tests, the bench and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "mapweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and as many shuffle partitions as local cores.

    On a cluster the master and the sizes come from spark-submit; only settings
    that change results (time zone) or plans (AQE) are forced here.
    """
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER_SET"):
        builder = builder.master(master or "local[*]")
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MAPWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
