"""Reliability coefficients from sums by person and item; no person-by-item matrix is pivoted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.operators import crossed
from fovea.operators.stats import pearson
from fovea.sources.shared import keep


def one_per_cell(df: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, who, item).agg(F.avg(value).alias("value")).where("value is not null")


def complete_only(cells: DataFrame, who: str, item: str, groups: Sequence[str] = ()) -> DataFrame:
    """Cells of people who have every item of the group."""
    items = cells.groupBy(*groups).agg(F.countDistinct(item).alias("_k"))
    own = cells.groupBy(*groups, who).agg(F.count(F.lit(1)).alias("_n"))
    joined = own.join(items, list(groups)) if groups else own.crossJoin(F.broadcast(items))
    return cells.join(joined.where("_n = _k").select(*groups, who), [*groups, who], "left_semi")


def margins(cells: DataFrame, who: str, item: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, side (0 person, 1 item, 2 all), c, s, ss, v of the cells by person, by item and in all: one pass over them."""
    sets = [[F.col(c) for c in (*groups, *more)] for more in ((who,), (item,), ())]
    value = F.col("value")
    rows = cells.groupingSets(sets, *groups, who, item).agg(F.grouping(who).alias("_w"), F.grouping(item).alias("_i"), F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"), F.sum(value * value).alias("ss"), F.var_samp(value).alias("v"))
    return rows.select(*groups, F.when(F.col("_w") == 0, 0).when(F.col("_i") == 0, 1).otherwise(2).alias("side"), "c", "s", "ss", "v")


def _of(side: int, c: str | Column) -> Column:
    return F.when(F.col("side") == side, F.col(c) if isinstance(c, str) else c)


def cronbach_alpha(df: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, items, people, alpha = k/(k-1) * (1 - sum of item variances / variance of totals of what people have)."""
    both = margins(one_per_cell(df, who, item, value, groups), who, item, groups).groupBy(*groups)
    both = both.agg(F.count(_of(1, "c")).alias("items"), F.count(_of(0, "c")).alias("people"), F.sum(_of(1, "v")).alias("parts"), F.var_samp(_of(0, "s")).alias("whole")).where("people > 0")
    k = F.col("items")
    return both.select(*groups, "items", "people", F.when((k > 1) & (F.col("people") > 1), k / (k - 1) * (1 - F.try_divide(F.col("parts"), F.when(F.col("whole") > 0, F.col("whole"))))).alias("alpha"))


def stratified_alpha(df: DataFrame, who: str, item: str, value: str, stratum: str) -> DataFrame:
    """alpha over strata of items: 1 - sum of var_s * (1 - alpha_s) / variance of totals."""
    parts = cronbach_alpha(df, who, item, value, [stratum])
    cells = one_per_cell(df, who, item, value, [stratum])
    spread = cells.groupBy(stratum, who).agg(F.sum("value").alias("t")).groupBy(stratum).agg(F.var_samp("t").alias("v"))
    whole = cells.groupBy(who).agg(F.sum("value").alias("t")).agg(F.var_samp("t").alias("whole"))
    return parts.join(spread, stratum).agg(F.sum(F.col("v") * (1 - F.col("alpha"))).alias("bad")).crossJoin(whole).select((1 - F.try_divide(F.col("bad"), F.col("whole"))).alias("stratified_alpha"))


def spearman_brown(r: Column) -> Column:
    return F.try_divide(2 * r, 1 + r)


def split_half(df: DataFrame, halves: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, draws, r_mean, r_sd (of the population), reliability (stepped up). halves: draw, item, half."""
    cells = one_per_cell(df, who, item, value, groups)
    sides = cells.join(F.broadcast(halves), item).groupBy(*groups, "draw", who).agg(F.avg(F.when(F.col("half") == 0, F.col("value"))).alias("x"), F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("y"))
    draws = sides.groupBy(*groups, "draw").agg(pearson("x", "y").alias("r"))
    return draws.groupBy(*groups).agg(F.count("r").alias("draws"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"), F.avg(spearman_brown(F.col("r"))).alias("reliability"))


def icc(df: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, items, people and the six coefficients icc1, icc2, icc3, icc1k, icc2k, icc3k over complete people."""
    cells = complete_only(keep(one_per_cell(df, who, item, value, groups)), who, item, groups)
    square = F.col("s") * F.col("s") / F.col("c")
    t = margins(cells, who, item, groups).groupBy(*groups).agg(
        F.count(_of(0, "c")).alias("people"), F.sum(_of(0, square)).alias("by_who"), F.count(_of(1, "c")).alias("items"), F.sum(_of(1, square)).alias("by_item"),
        F.max(_of(2, "s")).alias("s"), F.max(_of(2, "ss")).alias("ss"), F.max(_of(2, "c")).alias("c"),
    )
    n, k, base = F.col("people"), F.col("items"), F.col("s") * F.col("s") / F.col("c")
    t = t.where("people > 1 and items > 1").withColumns({"msr": (F.col("by_who") - base) / (n - 1), "msc": (F.col("by_item") - base) / (k - 1), "msw": (F.col("ss") - F.col("by_who")) / (n * (k - 1)), "mse": (F.col("ss") - F.col("by_who") - F.col("by_item") + base) / ((n - 1) * (k - 1))})
    r, c, w, e = (F.col(x) for x in ("msr", "msc", "msw", "mse"))
    d = F.try_divide
    return t.select(*groups, "items", "people", d(r - w, r + (k - 1) * w).alias("icc1"), d(r - e, r + (k - 1) * e + k * (c - e) / n).alias("icc2"), d(r - e, r + (k - 1) * e).alias("icc3"), d(r - w, r).alias("icc1k"), d(r - e, r + (c - e) / n).alias("icc2k"), d(r - e, r).alias("icc3k"))


def icc_all_readers(df: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, people, icc1, icc1k with gaps allowed: unbalanced one-way analysis with the mean-size correction."""
    cells = one_per_cell(df, who, item, value, groups)
    own = cells.groupBy(*groups, who).agg(F.count(F.lit(1)).alias("c"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"))
    t = own.groupBy(*groups).agg(F.count(F.lit(1)).alias("people"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("ss").alias("within"), (F.sum(F.col("c") * F.col("m") * F.col("m")) - F.sum(F.col("c") * F.col("m")) * F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("between"))
    g = F.col("people")
    t = t.where("people > 1 and n > people").withColumns({"msb": F.col("between") / (g - 1), "msw": F.col("within") / (F.col("n") - g), "k0": (F.col("n") - F.col("cc") / F.col("n")) / (g - 1)})
    b, w, k = F.col("msb"), F.col("msw"), F.col("k0")
    return t.select(*groups, "people", F.try_divide(b - w, b + (k - 1) * w).alias("icc1"), F.try_divide(b - w, b).alias("icc1k"))


def icc_crossed_reml(df: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = (), rounds: int = 300) -> DataFrame:
    """groups, var_person, var_item, var_error, icc: person and item as crossed random effects, gaps allowed, by REML.

    People are added up by how many items they have, in one pass; null where the variances aren't determined.
    """

    def answer(parts, levels, items):
        found = crossed.variances(parts, levels, items, rounds=rounds)
        return [*found, found[0] / sum(found)] if found else [None] * 4

    cells = one_per_cell(df, who, item, value, groups)
    return crossed.solved(crossed.sums(cells, who, item, groups), groups, ["var_person", "var_item", "var_error", "icc"], answer)


def icc_pooled_mixed(df: DataFrame, who: str, item: str, value: str, group: str, keys: Sequence[str] = (), rounds: int = 300) -> DataFrame:
    """keys, icc2, icc3, icc2k, icc3k over all groups at once, each group with its own level.

    icc2: people and items random and crossed; icc3: items fixed, which holds the groups' levels. The k forms average
    over as many items as a person has met, on average. Null where a variance isn't determined.
    """

    def answer(parts, levels, items):
        people = sum(p[0] for _, p in parts)
        k = round(sum(n * p[0] for n, p in parts) / people)
        two, three = (crossed.variances(parts, levels, items, random_items, rounds) if k > 1 else None for random_items in (True, False))
        share = lambda v, n: v[0] / (v[0] + sum(x for x in v[1:] if x is not None) / n) if v else None
        return [share(two, 1), share(three, 1), share(two, k), share(three, k)]

    cells = one_per_cell(df, who, item, value, [*keys, group])
    return crossed.solved(crossed.sums(cells, who, item, keys, group), keys, ["icc2", "icc3", "icc2k", "icc3k"], answer)


def standard_error(sd: Column, reliability: Column) -> Column:
    """Of measurement: sd * sqrt(1 - reliability), at least 0."""
    return sd * F.sqrt(F.greatest(F.lit(0.0), 1 - reliability))


def person_sd(df: DataFrame, who: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, sd of people's mean values."""
    return df.groupBy(*groups, who).agg(F.avg(value).alias("m")).groupBy(*groups).agg(F.stddev_samp("m").alias("sd"))


COEFFICIENTS = ("icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")


def averaged(by_group: DataFrame, values: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """keys; the mean of each coefficient over the groups that have it, sums (people) and whole means (items)."""
    return by_group.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], *[F.sum(c).alias(c) for c in sums], *[F.floor(F.avg(c)).cast("long").alias(c) for c in means])


def icc_by_group(df: DataFrame, who: str, item: str, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, people, items and the mean of each group's six coefficients."""
    return averaged(icc(df, who, item, value, [*keys, group]), COEFFICIENTS, ["people"], ["items"], keys)


def icc_pooled(df: DataFrame, who: str, item: str, value: str, group: str) -> DataFrame:
    """people, items, icc1, icc1k over all groups at once: one-way over readers, on values centred in their group.

    Groups read other items, so one analysis of variance can't cross them; `items` is what a reader sees on average.
    """
    cells = one_per_cell(df, who, item, value, [group])
    middle = cells.groupBy(group).agg(F.avg("value").alias("_m"))
    centred = cells.join(middle, group).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    own = centred.groupBy(who).agg(F.count(F.lit(1)).alias("c"), F.countDistinct(item).alias("k"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"))
    t = own.agg(F.count(F.lit(1)).alias("people"), F.round(F.avg("k")).cast("long").alias("items"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("ss").alias("within"), (F.sum(F.col("c") * F.col("m") * F.col("m")) - F.sum(F.col("c") * F.col("m")) * F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("between"))
    g, k = F.col("people"), F.col("items")
    t = t.where("people > 1 and n > people and items > 1").withColumns({"b": F.col("between") / (g - 1), "w": F.col("within") / (F.col("n") - g), "k0": (F.col("n") - F.col("cc") / F.col("n")) / (g - 1)})
    below = F.col("b") + (F.col("k0") - 1) * F.col("w")
    t = t.withColumn("icc1", F.when(below > 0, F.try_divide(F.col("b") - F.col("w"), below)))
    return t.select("people", "items", "icc1", F.when(F.col("icc1") > -1 / (k - 1), k * F.col("icc1") / (1 + (k - 1) * F.col("icc1"))).alias("icc1k"))


def reliability_row(df: DataFrame, halves: DataFrame, who: str, item: str, value: str, groups: Sequence[str] = (), complete: bool = False) -> DataFrame:
    """groups, items, people, alpha, alpha_sem, split_half, split_half_sem, sd: the coefficients of each result cell.

    `complete`: alpha and its standard error on people who have every item, split halves on all.
    """
    cells = one_per_cell(df, who, item, value, groups).select(*groups, who, item, F.col("value").alias(value))
    full = complete_only(cells, who, item, groups) if complete else cells
    join = (lambda a, b: a.join(b, list(groups))) if groups else (lambda a, b: a.crossJoin(F.broadcast(b)))
    rows = join(cronbach_alpha(full, who, item, value, groups), person_sd(full, who, value, groups).withColumnRenamed("sd", "_full"))
    rows = join(join(rows, split_half(cells, halves, who, item, value, groups).select(*groups, F.col("reliability").alias("split_half"))), person_sd(cells, who, value, groups))
    return rows.select(*groups, "items", "people", "alpha", standard_error(F.col("_full"), F.col("alpha")).alias("alpha_sem"), "split_half", standard_error(F.col("sd"), F.col("split_half")).alias("split_half_sem"), "sd")


def split_correlations(halves: DataFrame, who: str, value: str, split: str, half: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, split, r, stepped_up of stored scores: a row a participant, split and half (0, 1) in."""
    sides = halves.groupBy(*groups, split, who).agg(F.avg(F.when(F.col(half) == 0, F.col(value))).alias("_x"), F.avg(F.when(F.col(half) == 1, F.col(value))).alias("_y"))
    return sides.groupBy(*groups, split).agg(pearson("_x", "_y").alias("r")).withColumn("stepped_up", spearman_brown(F.col("r")))


def split_summary(by_split: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, splits, mean and population sd of r and of the stepped-up r. Without groups: over all (group, split) values."""
    return by_split.groupBy(*groups).agg(F.count("r").alias("splits"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"), F.avg("stepped_up").alias("reliability"), F.stddev_pop("stepped_up").alias("reliability_sd"))


def part_of(item: str, parts: dict[str, tuple[int, int]]) -> Column:
    """The test part whose range (first, last) holds the item; null outside all."""
    out = F.lit(None).cast("string")
    for name, (first, last) in parts.items():
        out = F.when(F.col(item).between(first, last), name).otherwise(out)
    return out


def by_part(df: DataFrame, halves: DataFrame, who: str, item: str, value: str, parts: dict[str, tuple[int, int]], groups: Sequence[str] = ()) -> DataFrame:
    """groups, part, items, people, alpha, split_half of each part: the part is one more key of the same job."""
    rows = df.withColumn("part", part_of(item, parts)).where("part is not null")
    return reliability_row(rows, halves, who, item, value, [*groups, "part"]).select(*groups, "part", "items", "people", "alpha", "split_half")


def icc_by_part(df: DataFrame, who: str, item: str, value: str, parts: dict[str, tuple[int, int]], whole: str = "whole_test") -> DataFrame:
    """part, items, people and the six coefficients of each part and of the whole test."""
    part = F.explode(F.array_compact(F.array(part_of(item, parts), F.lit(whole))))
    return icc(df.withColumn("part", part), who, item, value, ["part"])


def over_parts(rows: DataFrame, whole: DataFrame, by: str) -> DataFrame:
    """by, people, parts and the unweighted means of the parts' alpha and split half, beside the whole test's columns."""
    means = rows.groupBy(by).agg(F.max("people").alias("people"), F.countDistinct("part").alias("parts"), F.avg("alpha").alias("avg_part_alpha"), F.avg("split_half").alias("avg_part_split_half"))
    return means.join(whole, by)
