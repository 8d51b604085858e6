"""Folds, halves and pools as small key tables that data is joined to."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def half_splits(items: Sequence, splits: int = 20, seed: int = 42) -> list[tuple[int, int, object]]:
    """(split, half, item): complementary halves of one permutation for each split; few items, drawn on the driver."""
    out = []
    for s in range(splits):
        order = np.random.RandomState(seed + s).permutation(len(items))
        cut = (len(items) + 1) // 2
        out += [(s, int(k >= cut), items[i]) for k, i in enumerate(order)]
    return out


def parity_halves(items: Sequence[int]) -> list[tuple[int, int, int]]:
    return [(0, i % 2, i) for i in items]


def stratified_folds(people: DataFrame, who: str, stratum: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """who, stratum, fold: each stratum dealt evenly over k folds in a random order that a hash of the key fixes.

    Strata are dealt where they lie; where one ends the next goes on, so fold sizes differ by one at most.
    """
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), who), who)
    placed = people.select(who, stratum).distinct().withColumn("_k", F.row_number().over(order) - 1)
    sizes = placed.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(stratum, "_before")  # a row a stratum
    return placed.join(F.broadcast(before), stratum).select(who, stratum, F.pmod(F.col("_k") + F.col("_before"), F.lit(k)).cast("int").alias(name))


def large_strata(people: DataFrame, stratum: str, least: int) -> DataFrame:
    """People in strata of at least `least`."""
    return people.join(people.groupBy(stratum).count().where(F.col("count") >= least).select(stratum), stratum, "left_semi")


def leave_one_out(people: DataFrame, key: str, name: str = "fold") -> DataFrame:
    """The key itself as the fold: leave a participant, language or item out."""
    return people.withColumn(name, F.col(key))


def fold_roles(folds: DataFrame, who: str, fold: str = "fold") -> DataFrame:
    """segment, role, who: for each fold its test people and everyone else as train. One row a person and fold."""
    segments = folds.select(F.col(fold).alias("segment")).distinct()
    role = F.when(F.col(fold) == F.col("segment"), "test").otherwise("train")
    return folds.crossJoin(F.broadcast(segments)).select("segment", role.alias("role"), who)


def pool_roles(people: DataFrame, who: str, group: str, pool: str, batch: str | None = None) -> DataFrame:
    """segment, role, who by content group: ALL trains on everybody, SEEN on the group, UNSEEN on other batches."""
    segments = people.select(F.col(group).alias("segment"), *([F.col(batch).alias("_b")] if batch else [])).distinct()
    test = people.select(F.col(group).alias("segment"), F.lit("test").alias("role"), who)
    rule = {"ALL": F.lit(True), "SEEN": F.col(group) == F.col("segment"), "UNSEEN": (F.col(batch) != F.col("_b")) if batch else (F.col(group) != F.col("segment"))}[pool]
    train = people.join(F.broadcast(segments), rule).select("segment", F.lit("train").alias("role"), who)
    return train.unionByName(test)


def resampled(df: DataFrame, order: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """A draw with replacement of about the fraction of rows: 1 gives all rows, 0 none."""
    if fraction == 1:
        return df
    return df.limit(0) if fraction == 0 else df.sample(True, fraction, seed)


def random_item_halves(items: Sequence, strata: Sequence | None, draws: int, seed: int = 0) -> list[tuple[int, object, int]]:
    """(draw, item, half) for split-half reliability; strata are split evenly, an odd item goes to a random half."""
    rng, out = np.random.default_rng(seed), []
    strata = list(strata) if strata is not None else [0] * len(items)
    for d in range(draws):
        for s in sorted(set(strata), key=str):
            own = [x for x, t in zip(items, strata, strict=True) if t == s]
            order = rng.permutation(len(own))
            flip = int(rng.integers(2))
            out += [(d, own[i], (k + flip) % 2) for k, i in enumerate(order)]
    return out
