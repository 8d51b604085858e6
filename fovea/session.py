"""A Spark session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fovea", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skewed-join splitting and partition coalescing. Sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true"), ("spark.sql.adaptive.coalescePartitions.enabled", "true")):
        builder = builder.config(key, value)
    return builder.getOrCreate()
