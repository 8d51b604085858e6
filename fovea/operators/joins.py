"""Joins with the guarantees a data frame library's validated merge gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """Left join of the right side's columns; `check` fails on a repeated right key instead of multiplying rows."""
    columns = list(columns or [c for c in right.columns if c not in keys])
    right = right.select(*keys, *columns)
    if check and repeated_keys(right, keys).limit(1).count():
        raise ValueError(f"right side repeats {list(keys)}")
    return left.drop(*columns).join(right, list(keys), "left")


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the least by `order`: a repeatable drop-duplicates."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def inner_with_lost(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the keys that only one side has, with that side's name."""
    keys = list(keys)
    lost = left.select(*keys).distinct().join(right, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(right.select(*keys).distinct().join(left, keys, "left_anti").withColumn("side", F.lit("right")))
    return left.join(right, keys), lost


def with_suffix(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_meta") -> DataFrame:
    """Inner join; the right side's clashing columns get a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys))


def wide_scores(scores: DataFrame, who: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column for each named score; participants who lack any go."""
    return scores.groupBy(who).pivot(name, list(names)).agg(F.first(value)).dropna()


def override(base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The other source's cell where it has one, else the own."""
    renamed = other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return base.join(renamed, list(keys), "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def repair_ids(df: DataFrame, fixes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Literal replacements by one lookup: a replaced id isn't replaced again. fixes: keys, old_id, new_id."""
    fixes = fixes.select(*keys, F.col("old_id").alias(column), "new_id")
    return df.join(fixes, [*keys, column], "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id")


def unordered_pairs(df: DataFrame, group: Sequence[str], name: str, value: str, last: str | None = None) -> DataFrame:
    """Every two named series side by side on the group keys: a, b, x, y. A baseline `last` is always side b."""
    a = df.select(*group, F.col(name).alias("a"), F.col(value).alias("x"))
    b = df.select(*group, F.col(name).alias("b"), F.col(value).alias("y"))
    rank = (lambda c: F.struct((F.col(c) == last), F.col(c))) if last is not None else F.col
    return a.join(b, list(group)).where(rank("a") < rank("b"))


def shift_after_drop(df: DataFrame, dropped: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Removes the dropped (keys, index) and closes the gaps: each index falls by the dropped ones before it."""
    marks = dropped.select(*keys, F.col(index).alias("_gone")).distinct()
    gaps = marks.groupBy(*keys).agg(F.collect_set("_gone").alias("_all"))
    joined = df.join(gaps, list(keys), "left")
    gone = F.coalesce("_all", F.array().cast("array<bigint>"))
    joined = joined.where(~F.array_contains(gone, F.col(index).cast("bigint")) | F.col(index).isNull())
    return joined.withColumn(index, F.col(index) - F.size(F.filter(gone, lambda g: g < F.col(index)))).drop("_all")


def tagged_union(frames: dict[str, DataFrame], tag: str = "cohort") -> DataFrame:
    """All rows with the name of their frame; split again by filtering on it."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def by_membership(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is among the members, and the others."""
    ids = members.select(key).distinct()
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def with_cells(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with their long-form cells (keys, feature, value): the per-text columns of a subset, of which each row has its
    own few. Rows without cells stay once, their feature null."""
    return rows.join(cells, list(keys), "left")
