"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fovea-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, folder)


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """A folder for this application's kept tables, removed when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/kept-{app}-{uuid.uuid4().hex}"
        atexit.register(_remove_at_end, spark, _roots[app])
    return _roots[app]


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back, so no later step recomputes it."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """keep(), in so many buckets by hash of `key`: what groups or joins by the key later reads the table without a shuffle."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", place(spark)).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry alone: the files stay, and the frame knows them
    return table
