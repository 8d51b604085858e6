"""Correlations, dependent-correlation tests, resampling and error metrics by group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.functions.special import correlation_t, t_p_value, z_p_value
from fovea.operators import resampling
from fovea.operators.ranks import average_ranks
from fovea.operators.windows import average_rank


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation over complete pairs; null for fewer than `least` or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(F.count(F.when(both, 1)) >= least, F.try_divide(F.covar_samp(a, b), F.when(spread > 0, spread)))


def correlations(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """groups, n, pearson_r[, pearson_p]."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = complete.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("pearson_r"))
    return out.withColumn("pearson_p", t_p_value(correlation_t(F.col("pearson_r"), F.col("n")), (F.col("n") - 2).cast("double"))) if with_p else out


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, spearman_r: the correlation of average ranks over complete pairs."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if groups:
        ranked = complete.withColumns({"_x": average_rank(x, groups), "_y": average_rank(y, groups)})
    else:
        ranked = average_ranks(average_ranks(complete.select(x, y), x, "_x"), y, "_y")
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("spearman_r"))


def with_total(df: DataFrame, cell: Sequence[str], by: str, aggs: Sequence[Column], total: str = "All") -> DataFrame:
    """The aggregates by cell and key, and by cell alone under the name `total`: one job over grouping sets."""
    marked = df.groupingSets([[*map(F.col, cell), F.col(by)], [F.col(c) for c in cell]], *cell, by).agg(F.grouping(by).alias("_g"), *aggs)
    return marked.withColumn(by, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(by))).drop("_g")


def error_metrics(true: str, pred: str) -> list[Column]:
    """n, r2, rmse, mae, pearson_r as aggregates."""
    t, p = F.col(true), F.col(pred)
    n = F.count(F.when(t.isNotNull() & p.isNotNull(), 1))
    square = F.sum((t - p) * (t - p))
    return [n.alias("n"), (1 - F.try_divide(square, F.var_pop(t) * n)).alias("r2"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"), pearson(true, pred).alias("pearson_r")]


def adjusted_r2(r2: str, n: str, features: str | int) -> Column:
    k = F.lit(features) if isinstance(features, int) else F.col(features)
    return 1 - (1 - F.col(r2)) * F.try_divide(F.col(n) - 1, F.col(n) - k - 1)


def _testable(*r: Column, n: Column) -> Column:
    """Four rows at least and correlations inside (-1, 1); a test of others has no value."""
    inside = n >= 4
    for c in r:
        inside = inside & (F.abs(F.nanvl(c.cast("double"), F.lit(1.0))) < 1)
    return inside


def steiger_z(ra: Column, rb: Column, rab: Column, n: Column) -> Column:
    """Test of two correlations that share a variable, with the covariance of their Fisher transforms.

    Null for fewer than four rows, a correlation that is null, not finite or not inside (-1, 1), or no positive variance.
    """
    rest = 1 - ra * ra - rb * rb
    s = F.try_divide(rab * rest - ra * rb * (rest - rab * rab) / 2, (1 - ra * ra) * (1 - rb * rb))
    spread = F.when(2 - 2 * s > 0, F.sqrt(2 - 2 * s))
    return F.when(_testable(ra, rb, rab, n=n), F.try_divide((F.atanh(ra) - F.atanh(rb)) * F.sqrt(n - 3), spread))


def meng_z(ra: Column, rb: Column, rab: Column, n: Column) -> Column:
    """Test of two correlations that share a variable, with the mean square correlation in the correction. Null as `steiger_z`."""
    square = (ra * ra + rb * rb) / 2
    f = F.least(F.lit(1.0), F.try_divide(1 - rab, 2 * (1 - square)))
    h = F.try_divide(1 - f * square, 1 - square)
    spread = F.when(h > 0, 2 * (1 - rab) * h)
    return F.when(_testable(ra, rb, rab, n=n), (F.atanh(ra) - F.atanh(rb)) * F.sqrt(F.try_divide(n - 3, spread)))


def compared(pairs: DataFrame, group: Sequence[str], target: str, x: str = "x", y: str = "y") -> DataFrame:
    """For each pair of predictors of one target: their correlations, n, both tests and their p."""
    complete = pairs.dropna(subset=[target, x, y])
    sums = complete.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson(x, target).alias("r_a"), pearson(y, target).alias("r_b"), pearson(x, y).alias("r_ab"))
    args = [F.col(c) for c in ("r_a", "r_b", "r_ab", "n")]
    tested = sums.withColumns({"steiger_z": steiger_z(*args), "meng_z": meng_z(*args)})
    return tested.withColumns({"steiger_p": z_p_value("steiger_z"), "meng_p": z_p_value("meng_z")})


def pair_kinds(pairs: DataFrame, set_a: str, set_b: str, model_a: str, model_b: str, baseline_set: str, baseline_model: str) -> DataFrame:
    """pairs with is_baseline (a side is the baseline feature set) and is_ridge (one feature set, one side the baseline model)."""
    base = (F.col(set_a) == baseline_set) | (F.col(set_b) == baseline_set)
    one_side = (F.col(model_a) == baseline_model) != (F.col(model_b) == baseline_model)
    return pairs.withColumns({"is_baseline": base, "is_ridge": (F.col(set_a) == F.col(set_b)) & one_side})


def window_curve(df: DataFrame, pred: str, true: str, window: str, groups: Sequence[str] = (), full: str | None = None) -> DataFrame:
    """groups, window, n, pearson_r, mae[, bias against the column of the value over everything] of every moving window."""
    aggs = [F.count(F.when(F.col(pred).isNotNull() & F.col(true).isNotNull(), 1)).alias("n"), pearson(pred, true).alias("pearson_r"), F.avg(F.abs(F.col(pred) - F.col(true))).alias("mae")]
    return df.groupBy(*groups, window).agg(*aggs, *([F.avg(F.col(pred) - F.col(full)).alias("bias")] if full else []))


def lookup(df: DataFrame, cells: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """cells, n and a correlation for each name -> (column, column): r of raw and debiased scores, or of either with the target."""
    return df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), *[pearson(x, y).alias(name) for name, (x, y) in pairs.items()])


def matrix(long: DataFrame, who: str, name: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, a, b, n, pearson_r, mean_abs_diff of every two named series, by a join on the participant."""
    a = long.select(*groups, who, F.col(name).alias("a"), F.col(value).alias("x"))
    b = long.select(*groups, who, F.col(name).alias("b"), F.col(value).alias("y"))
    both = a.join(b, [*groups, who]).where("a <= b and x is not null and y is not null")
    return both.groupBy(*groups, "a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson_r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))


def bootstrap(df: DataFrame, groups: Sequence[str], x: str, y: str, draws: int = 100_000, seed: int = 42, who: str | None = None, mae: bool = False) -> DataFrame:
    """groups, n, r, boot_mean, boot_sd, low, high (percentiles 2.5 and 97.5); with `mae` the same of the mean absolute
    difference: mae, mae_mean, mae_sd, mae_low, mae_high. A group is one cell of a result table.

    Null under three rows or where a side is constant (the mean absolute difference under three rows alone). `who`
    names the row's person, whose weights are the same in every cell; without it equal rows are told apart.
    """
    a, b = F.col(f"_c_{x}"), F.col(f"_c_{y}")
    rows = resampling.centred(resampling.usable(df, [x, y]).select(*groups, x, y, resampling.row_key(groups, [x, y], who).alias("_row")), groups, [x, y])
    terms = [F.lit(1.0), a, b, a * a, b * b, a * b, F.abs(F.col(x) - F.col(y))]
    names = ["n", "r", "boot_mean", "boot_sd", "low", "high", *(["mae", "mae_mean", "mae_sd", "mae_low", "mae_high"] if mae else [])]

    def finish(held: np.ndarray) -> list:
        n, off = held[0, 0], held[0, 6]
        if n[0] < 3:
            return [int(n[0]), *[None] * (len(names) - 1)]
        r = resampling.correlation(*held[0, :6])
        with np.errstate(all="ignore"):
            off = off / n
        sides = [r, off] if mae else [r]
        return [int(n[0]), *(v for side in sides for v in ([side[0], *resampling.interval(side[1:])] if np.isfinite(side[0]) else [None] * 5))]

    sums = resampling.weighted_sums(rows, groups, F.col("_row"), terms, draws, seed)
    return resampling.finished(sums, groups, len(terms), [], names, finish)


def bootstrap_difference(df: DataFrame, groups: Sequence[str], target: str, x: str, y: str, draws: int = 100_000, seed: int = 42, who: str | None = None, mae: bool = False) -> DataFrame:
    """groups, n, delta_r = r(x, target) - r(y, target), its interval, and p centred on no difference, at least 1/draws;
    with `mae` the same of the mean absolute errors: delta_mae, mae_low, mae_high, mae_p. `who` as in `bootstrap`."""
    t, a, b = (F.col(f"_c_{c}") for c in (target, x, y))
    three = [target, x, y]
    rows = resampling.centred(resampling.usable(df, three).select(*groups, *three, resampling.row_key(groups, three, who).alias("_row")), groups, three)
    terms = [F.lit(1.0), t, a, b, t * t, a * a, b * b, t * a, t * b, F.abs(F.col(target) - F.col(x)), F.abs(F.col(target) - F.col(y))]
    names = ["n", "delta_r", "low", "high", "p", *(["delta_mae", "mae_low", "mae_high", "mae_p"] if mae else [])]

    def tested(d: np.ndarray) -> list:
        drawn = d[1:][np.isfinite(d[1:])]
        if not np.isfinite(d[0]) or not len(drawn):
            return [None] * 4
        return [d[0], *np.percentile(drawn, [2.5, 97.5]), max(1 / draws, float((np.abs(drawn - d[0]) >= abs(d[0])).mean()))]

    def finish(held: np.ndarray) -> list:
        n, t, a, b, tt, aa, bb, ta, tb, off_a, off_b = held[0]
        if n[0] < 3:
            return [int(n[0]), *[None] * (len(names) - 1)]
        r = resampling.correlation(n, a, t, aa, tt, ta) - resampling.correlation(n, b, t, bb, tt, tb)
        with np.errstate(all="ignore"):
            off = (off_a - off_b) / n
        return [int(n[0]), *tested(r), *(tested(off) if mae else [])]

    sums = resampling.weighted_sums(rows, groups, F.col("_row"), terms, draws, seed)
    return resampling.finished(sums, groups, len(terms), [], names, finish)


def composite(df: DataFrame, columns: Sequence[str], name: str = "composite") -> DataFrame:
    """z-scores averaged over what a row has, scaled to 1..100 and rounded half to even."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    z = F.array_compact(F.array(*[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns]))
    scored = df.crossJoin(F.broadcast(stats)).withColumn("_z", F.try_divide(F.aggregate(z, F.lit(0.0), lambda a, e: a + e), F.size(z)))
    ends = scored.agg(F.min("_z").alias("_low"), F.max("_z").alias("_high"))
    scaled = scored.crossJoin(F.broadcast(ends)).withColumn(name, F.bround(1 + 99 * F.try_divide(F.col("_z") - F.col("_low"), F.col("_high") - F.col("_low"))))
    return scaled.select(*df.columns, name)


def first_component(df: DataFrame, who: str, columns: Sequence[str], rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """who, component: probabilistic PCA with one factor by EM over observed cells, loadings mostly positive.

    One aggregate gives, for each set of columns that a row can have, the number of rows and the sums of products; all
    rounds run on these. There are at most as many sets as rows, so many columns with scattered gaps want a plan of
    their own; rows stay where they are.
    """
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    k = len(columns)
    z = [F.try_divide(F.col(c) - F.lit(stats[f"m_{c}"]), F.lit(stats[f"s_{c}"])) for c in columns]
    data = df.select(who, *[e.alias(f"z{j}") for j, e in enumerate(z)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    held = data.groupBy(*[F.col(f"z{j}").isNotNull().alias(f"seen{j}") for j in range(k)]).agg(F.count(F.lit(1)).alias("n"), *products).collect()
    seen = np.array([[r[f"seen{j}"] for j in range(k)] for r in held], float).reshape(-1, k)
    number = np.array([r["n"] for r in held], float)
    square = np.zeros((len(held), k, k))
    for i, j in pairs:
        square[:, i, j] = square[:, j, i] = [r[f"p{i}_{j}"] or 0.0 for r in held]
    own = square[:, range(k), range(k)].sum(axis=0)
    w, noise = np.full(k, 0.5), 1.0

    for _ in range(rounds):
        below = seen @ (w * w) + noise
        a = ((square @ w) / below[:, None]).sum(axis=0)  # sums of z and the factor's mean
        b = (number * noise / below + np.einsum("j,pjl,l->p", w, square, w) / below**2) @ seen  # of the factor's square, where the column is there
        new = np.divide(a, b, out=np.zeros(k), where=b != 0)
        total = (own - 2 * new * a + new**2 * b).sum()
        noise_new = max(1e-9, total / max(1.0, float((number @ seen).sum())))
        done = np.abs(new - w).max() < tolerance and abs(noise_new - noise) < tolerance
        w, noise = new, noise_new
        if done:
            break
    if w.mean() < 0:
        w = -w
    below = sum((F.when(F.col(f"z{j}").isNotNull(), float(w[j] ** 2)).otherwise(0.0) for j in range(k)), F.lit(float(noise)))
    dot = sum((F.coalesce(F.col(f"z{j}") * float(w[j]), F.lit(0.0)) for j in range(1, k)), F.coalesce(F.col("z0") * float(w[0]), F.lit(0.0)))
    return data.select(who, (dot / below).alias("component"))
