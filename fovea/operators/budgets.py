"""Cutting per-text columns down to a budget, on the table of column names; no data is touched.

columns: name, paragraph, low, high (the words a column is about; equal for single words). The choice depends on names
alone, so it is the same in every fold. Tables of names are small: a few ten thousand rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.scalars import natural_key


def in_reading_order(columns: DataFrame, budget: int, always: int = 0) -> DataFrame:
    """Whole words in reading order until the budget runs out; a column belongs to its later word.

    `always` columns outside the texts are kept and count against the budget.
    """
    units = columns.groupBy("paragraph", "high").agg(F.count(F.lit(1)).alias("cost"))
    upto = Window.orderBy(natural_key("paragraph"), "high").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a word
    fits = units.withColumn("upto", F.sum("cost").over(upto)).where(F.col("upto") <= budget - always).select("paragraph", "high")
    return columns.join(fits, ["paragraph", "high"], "left_semi")


def in_windows(columns: DataFrame, cap: int, anchor: str = "middle") -> DataFrame:
    """For each paragraph the columns of its largest word window with at most `cap` of them.

    Windows grow from the start, from the end or around the middle word; a column joins at the first window that
    holds both its words, so one running count by that step decides.
    """
    words = columns.select("paragraph", F.explode(F.array("low", "high")).alias("word")).distinct()
    by = Window.partitionBy("paragraph")
    places = words.select("paragraph", "word", (F.row_number().over(by.orderBy("word")) - 1).alias("place"), F.count(F.lit(1)).over(by).alias("words"))
    low, high = (places.select("paragraph", F.col("word").alias(c), F.col("place").alias(f"_{c}"), *(["words"] if c == "low" else [])) for c in ("low", "high"))
    middle = F.floor(F.col("words") / 2)
    step = {"start": F.col("_high"), "end": F.col("words") - 1 - F.col("_low"), "middle": F.greatest(middle - F.col("_low"), F.col("_high") - middle)}[anchor]
    placed = columns.join(low, ["paragraph", "low"]).join(high, ["paragraph", "high"]).withColumn("_step", step)
    return placed.withColumn("_upto", F.count(F.lit(1)).over(by.orderBy("_step").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_upto") <= cap).select(*columns.columns)


def within_budget(columns: DataFrame, budget: int, pairs: bool, always: int = 0) -> DataFrame:
    """All columns if they fit; else word pairs by an even share around each paragraph's middle, single words in reading order."""
    size = columns.agg(F.count(F.lit(1)), F.countDistinct("paragraph")).first()
    if size[0] + always <= budget:
        return columns
    if budget < always:
        raise ValueError(f"{always} other columns exceed the budget of {budget}")
    return in_windows(columns, max(1, (budget - always) // max(1, size[1]))) if pairs else in_reading_order(columns, budget, always)
