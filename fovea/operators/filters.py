"""Row and column filters. Each takes and gives a DataFrame; key sets are joined, never collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_readers(df: DataFrame, who: str, items: Sequence[str], needed: int) -> DataFrame:
    """Rows of participants who have `needed` distinct items."""
    complete = df.groupBy(who).agg(F.countDistinct(*items).alias("n")).where(F.col("n") == needed).select(who)
    return df.join(complete, who, "left_semi")


def first_n(df: DataFrame, who: str, order: Sequence[str], n: int) -> DataFrame:
    """Rows of each participant's first n distinct items in the given order."""
    place = F.dense_rank().over(Window.partitionBy(who).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def first_by_id(df: DataFrame, item: str, n: int) -> DataFrame:
    """Rows of items 1 to n by id."""
    return df.where(F.col(item).between(1, n))


def trials(df: DataFrame, kind: str, who: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """What an aggregation kind reads: 'all', 'first' (n in order) or 'first_id' (ids up to n)."""
    if kind == "all":
        return df
    if n is None:
        raise ValueError(f"{kind} needs n")
    if kind == "first":
        return first_n(df, who, order, n)
    if kind == "first_id":
        return first_by_id(df, order[0], n)
    raise ValueError(f"unknown kind {kind}")


def condition(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; a column that isn't there doesn't restrict."""
    for c, value in wanted.items():
        if c in df.columns and value is not None:
            df = df.where(F.col(c) == value)
    return df


def preview(df: DataFrame, mode: str, column: str = "question_preview") -> DataFrame:
    """'All', 'Hunting' (previewed) or 'Gathering' (not)."""
    flags = {"All": None, "Hunting": 1, "Gathering": 0}
    return condition(df, **{column: flags[mode]})


def valid_targets(df: DataFrame, target: str, features: Sequence[str], missing: float = -1.0) -> DataFrame:
    """Rows with a taken test and at least one feature."""
    return df.where(F.col(target).isNotNull() & ~F.isnan(target) & (F.col(target) != missing)).dropna("all", subset=list(features))


def enough_paragraphs(halves: DataFrame, who: str, least: int, count: str = "n_paragraphs", half: str = "half") -> DataFrame:
    """Rows of participants with at least `least` paragraphs in every one of their halves."""
    good = halves.groupBy(who).agg(F.min(count).alias("n"), F.countDistinct(half).alias("h")).where((F.col("n") >= least) & (F.col("h") == 2)).select(who)
    return halves.join(good, who, "left_semi")


def shared_combos(natives: DataFrame, learners: DataFrame, combo: Sequence[str]) -> DataFrame:
    """Native rows whose combination also occurs among the learners."""
    return natives.join(learners.select(*combo).distinct(), list(combo), "left_semi")


def only_read(fixations: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixations of the (participant, paragraph) pairs that the word table has."""
    return fixations.join(words.select(*keys).distinct(), list(keys), "left_semi")


def filled_columns(df: DataFrame, columns: Sequence[str], fully: bool = False) -> list[str]:
    """Of the columns, those with any value; with `fully`, those without a gap. One job over all of them."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first()
    return [c for c in columns if (counts[c] == counts["_n"] if fully else counts[c] > 0)]


def covered_features(long: DataFrame, feature: str, who: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Long form of the same: rows of features that every participant (of the group) has."""
    readers = long.groupBy(*groups).agg(F.countDistinct(who).alias("_all"))
    full = long.where(F.col(value).isNotNull()).groupBy(*groups, feature).agg(F.countDistinct(who).alias("_n"))
    full = full.join(readers, list(groups)) if groups else full.crossJoin(F.broadcast(readers))
    return long.join(full.where("_n = _all").select(*groups, feature), [*groups, feature], "left_semi")


def varying(stats: DataFrame, sd: str = "sd") -> DataFrame:
    """Feature statistics with any spread."""
    return stats.where(F.col(sd) > 0)


def valid_scheme(pool: str, folds: str) -> bool:
    """Which pool goes with which fold method."""
    return pool in ("ALL", "SEEN", "UNSEEN") and folds in ("POOL_ALL", "LOLO", "L1_STRAT_KFOLD") and not (pool == "UNSEEN" and folds == "POOL_ALL")


def require_seen(columns: Sequence[str], per_text: bool, pool: str, group: str = "content_group") -> None:
    """Per-text features only make sense inside a content group."""
    if per_text and group in columns and pool != "SEEN":
        raise ValueError("per-text features need the SEEN pool where there are content groups")


def version_matches(column: str, name: str):
    """A path equal to the name or nested below it."""
    return (F.col(column) == name) | F.col(column).startswith(f"{name}/")


def common_columns(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def displayed(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Result rows whose cell (the columns of `shown`, a small table) is one that a table shows."""
    return rows.join(F.broadcast(shown.distinct()), shown.columns, "left_semi")


def feature_set_columns(columns: Sequence[str], wanted: Sequence[str], prefix: str | None, about: Sequence[str] = ("participant_id", "L1", "content_group")) -> tuple[list[str], list[str]]:
    """Columns of a feature set, what is known of its rows first, and those that are missing; with a prefix, all columns that bear it."""
    found = [c for c in columns if c.startswith(prefix)] if prefix else [c for c in wanted if c in columns]
    return [c for c in about if c in columns] + found, [] if prefix else [c for c in wanted if c not in columns]


def without_metadata(df: DataFrame, metadata: Sequence[str]) -> DataFrame:
    return df.drop(*metadata)


def language_column(df: DataFrame) -> str | None:
    """'language' if the table has it, else 'L1', else None."""
    return next((c for c in ("language", "L1") if c in df.columns), None)


def target_columns(sets: Mapping[str, Mapping[str, Sequence[str]]], dataset: str, name: str, override: Sequence[str] | None = None) -> list[str]:
    """The targets of a named set for a dataset; an override wins, an unknown set is an error."""
    if override:
        return list(override)
    if name not in sets:
        raise ValueError(f"unknown target set {name!r}; expected one of {sorted(sets)}")
    return list(sets[name].get(dataset, ()))
