"""Intermediate tables that end with the work they serve, and names that clash with no column."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fovea.sources.shared import keep, remove, shared_dir

__all__ = ["Scratch", "fresh", "give_back", "keep", "shared_dir"]


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: workers live on, and what one stage has used the next need not pay for."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Scratch:
    """Kept tables that end with the work they serve. What outlives it must be kept elsewhere before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)
