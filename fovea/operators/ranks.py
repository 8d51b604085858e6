"""Positions over a whole table, without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.sources.shared import keep

_ROW_BITS = 33  # monotonically_increasing_id() counts a task's rows in so many low bits


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with a column `name`: each row's place, from 1, in the order of all rows.

    Rows are dealt into ranges, sorted there and counted; a range's first place is the number of rows before it.
    One shuffle and one kept table; the driver and a broadcast hold a number for each range, as many as there are
    shuffle partitions. Rows with equal keys share a task: end the order with a column that tells them apart where
    many are equal. An empty table stays empty.
    """
    at, part, first = (f"_{name}_{x}" for x in ("at", "part", "first"))
    kept = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    kept = kept.withColumn(part, F.shiftright(at, _ROW_BITS)).withColumn(at, F.col(at).bitwiseAND((1 << _ROW_BITS) - 1))
    before, firsts = 0, []
    for row in sorted(kept.groupBy(part).count().collect()):
        firsts.append((row[0], before))
        before += row[1]
    ranges = df.sparkSession.createDataFrame(firsts, f"{part} long, {first} long")
    return kept.join(F.broadcast(ranges), part).withColumn(name, F.col(first) + F.col(at) + 1).drop(at, part, first)


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with a column `name`: the rank of `value` among all rows, ties at their mean, null for null.

    Values are counted before anything moves, so a value that many rows have is one row; the distinct values are dealt
    into ranges, each range's rows counted, and a rank is what lies before the value and half of what equals it. Rows
    get it back by a join on the value. No task sees all rows.
    """
    tied, part, before, up_to = (f"_{name}_{x}" for x in ("tied", "part", "before", "up_to"))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias(tied))
    kept = keep(counts.repartitionByRange(value).sortWithinPartitions(value).withColumn(part, F.spark_partition_id()))
    total, firsts = 0, []
    for row in sorted(kept.groupBy(part).agg(F.sum(tied)).collect()):
        firsts.append((row[0], total))
        total += row[1]
    ranges = df.sparkSession.createDataFrame(firsts, f"{part} int, {before} long")
    own = kept.withColumn(up_to, F.sum(tied).over(Window.partitionBy(part).orderBy(value))).join(F.broadcast(ranges), part)
    ranked = own.select(value, (F.col(before) + F.col(up_to) - (F.col(tied) - 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, value, "left").select(*df.columns, name)
