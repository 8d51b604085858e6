"""Ranks and positions over whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from fovea.operators import ranks, stats


@pytest.mark.parametrize("tasks,most", [(1, 5), (7, 5), (7, 1), (7, 1000)])
def test_average_ranks_equal_a_sort(spark, tasks, most):
    rng = random.Random(most)
    values = [rng.randrange(most) if rng.random() < 0.9 else None for _ in range(300)] + [float("inf"), float("-inf")]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "k long, v double").repartition(tasks)
    got = {r["k"]: r["rank"] for r in ranks.average_ranks(df, "v").collect()}
    known = [v for v in values if v is not None]
    assert len(got) == len(values)
    for k, v in enumerate(values):
        assert got[k] == (None if v is None else sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2)


def test_positions_count_on_across_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), k) for k in range(500)]
    df = spark.createDataFrame(rows, "v int, k long").repartition(9)
    got = sorted((r["position"], -r["v"], r["k"]) for r in ranks.positions(df, F.desc("v"), "k").collect())
    assert got == [(i + 1, *x) for i, x in enumerate(sorted((-v, k) for v, k in rows))]
    assert ranks.positions(df.limit(0), "k").count() == 0 and ranks.average_ranks(df.limit(0), "k").count() == 0


def test_no_task_has_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), (F.col("id") * 37 % 101).alias("y"))
    out = stats.spearman(df, "x", "y")
    parts = out._jdf.queryExecution().executedPlan().toString().split("Exchange SinglePartition")
    assert len(parts) <= 2 and "Window" not in parts[0]  # the last sums alone
