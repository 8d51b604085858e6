"""Ordered computations inside trials."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_flags(df: DataFrame, trial: Sequence[str], order: Sequence[str], left: str) -> DataFrame:
    """start_of_line and end_of_line from jumps of the left edge; the first word starts and the last ends a line."""
    w = Window.partitionBy(*trial).orderBy(*order)
    return df.withColumns({"start_of_line": F.lag(left, 1, 1_000_000).over(w) > F.col(left), "end_of_line": F.lead(left, 1, -1).over(w) < F.col(left)})


def span_metrics(df: DataFrame, trial: Sequence[str], index: str, dwell: str) -> DataFrame:
    """The index shifted to start at 0, and its range and the total dwell of the trial, on every row."""
    w = Window.partitionBy(*trial)
    low, high = F.min(index).over(w), F.max(index).over(w)
    return df.withColumns({"min_index": F.lit(0), "max_index": high - low, "total_dwell": F.sum(dwell).over(w), index: F.col(index) - low})


def normalized_index(df: DataFrame, trial: Sequence[str], index: str, name: str = "normalized_ID", whole_table: bool = False) -> DataFrame:
    """The index scaled to 0..1 in its trial, null in trials of one word. `whole_table` scales over all rows instead."""
    if whole_table:
        ends = df.agg(F.min(index).alias("_low"), F.max(index).alias("_high"))
        return df.crossJoin(F.broadcast(ends)).withColumn(name, F.try_divide(F.col(index) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")
    w = Window.partitionBy(*trial)
    low, high = F.min(index).over(w), F.max(index).over(w)
    return df.withColumn(name, F.try_divide(F.col(index) - low, high - low))


def next_fixation(df: DataFrame, trial: Sequence[str], order: Sequence[str], current: str, name: str = "next_ia") -> DataFrame:
    """The word fixated next in the trial; the last fixation has none."""
    return df.withColumn(name, F.lead(current).over(Window.partitionBy(*trial).orderBy(*order)))


def share_of_total(value: str, trial: Sequence[str]) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*trial)))


def positional_windows(df: DataFrame, who: str, order: Sequence[str], size: int) -> DataFrame:
    """One row per row and window of `size` consecutive distinct items that holds it; window_index counts from 0."""
    by = Window.partitionBy(who)
    placed = df.withColumn("_at", F.dense_rank().over(by.orderBy(*order)))
    placed = placed.withColumn("_last", F.greatest(F.max("_at").over(by) - size, F.lit(0)))
    starts = F.sequence(F.greatest(F.col("_at") - size, F.lit(0)), F.least(F.col("_at") - 1, F.col("_last")))
    return placed.withColumn("window_index", F.explode(starts)).drop("_at", "_last")


def id_windows(df: DataFrame, who: str, item: str, size: int) -> DataFrame:
    """Windows as ranges of `size` ids up to the participant's largest; empty ones are skipped by a dense index."""
    by = Window.partitionBy(who)
    last = F.greatest(F.max(item).over(by) - (size - 1), F.lit(1))
    starts = F.sequence(F.greatest(F.col(item) - (size - 1), F.lit(1)), F.least(F.col(item), F.col("_last")))
    return df.withColumn("_last", last).withColumn("_start", F.explode(starts)).withColumn("window_index", F.dense_rank().over(by.orderBy("_start")) - 1).drop("_start", "_last")


def go_past(df: DataFrame, trial: Sequence[str], order: Sequence[str], word: str, duration: str) -> DataFrame:
    """For each fixated word: the time from its first fixation up to the first fixation to its right.

    Fixations without a word or off the text (negative) are left out. A trial's fixations are one ordered array, walked
    once from its end with a stack of the words that still lie to the right.
    """
    on_text = df.where(F.col(word).isNotNull() & (F.col(word) >= 0))
    path = F.array_sort(F.collect_list(F.struct(*order, F.col(word).alias("_word"), F.coalesce(F.col(duration).cast("double"), F.lit(0.0)).alias("_time"))))
    trials = on_text.groupBy(*trial).agg(path.alias("_path"))
    trials = trials.select(*trial, F.col("_path._word").alias("_word"), F.col("_path._time").alias("_time"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = (batch.column(batch.schema.get_field_index(c)) for c in ("_word", "_time"))
            row, found, past = [], [], []
            for k, (own, spent) in enumerate(zip(words.to_pylist(), times.to_pylist(), strict=True)):
                so_far, ends, right = [0.0, *itertools.accumulate(spent)], {}, []
                for i in range(len(own) - 1, -1, -1):
                    while right and own[right[-1]] <= own[i]:
                        right.pop()
                    ends[own[i]] = (i, right[-1] if right else len(own))  # the earliest place stays
                    right.append(i)
                row += [k] * len(ends)
                found += ends
                past += [so_far[end] - so_far[first] for first, end in ends.values()]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(at) for c in trial), pa.array(found, words.type.value_type), pa.array(past, pa.float64())], names=[*trial, word, "go_past"])

    kinds = dict(df.dtypes)
    return trials.mapInArrow(walk, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*trial, word)), "go_past double"]))


def running_number(df: DataFrame, who: Sequence[str], order: Sequence[str], name: str = "window_index") -> DataFrame:
    """0, 1, 2, ... inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*who).orderBy(*order)) - 1)


def nth(df: DataFrame, who: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return running_number(df, who, order, "_n").where(F.col("_n") == n - 1).drop("_n")


def parity_split(df: DataFrame, who: Sequence[str], order: Sequence[str], name: str = "side") -> DataFrame:
    """Rows dealt to sides 0 and 1 in turn."""
    return running_number(df, who, order, name).withColumn(name, F.col(name) % 2)


def average_rank(value: str, groups: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean, null for null. Over whole tables: `ranks.average_ranks`."""
    scope = [F.col(value).isNull(), *map(F.col, groups)]
    rank = F.rank().over(Window.partitionBy(*scope).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*scope, value))
    return F.when(F.col(value).isNotNull(), rank + (ties - 1) / F.lit(2.0))
