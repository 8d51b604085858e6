"""Predictions under cross-validation: one grouped task for each (segment, fold), baselines as plain aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.scalars import clipped
from fovea.operators import gram

ALPHAS = tuple(np.logspace(-3, 4, 10))


def impute_native_targets(df: DataFrame, target: str, native: str, top: float, missing: float = -1.0) -> DataFrame:
    """A native who didn't take the test gets the natives' mean, or the best score if no native took it."""
    valid = F.when(F.col(native) & (F.col(target) != missing), F.col(target))
    means = df.agg(F.avg(valid).alias("_mean"))
    fill = F.when(F.col(native) & (F.col(target) == missing), F.coalesce("_mean", F.lit(top))).otherwise(F.col(target))
    return df.crossJoin(F.broadcast(means)).withColumn(target, fill).drop("_mean")


def leave_one_out_mean(df: DataFrame, y: str, groups: Sequence[str] = (), name: str = "pred") -> DataFrame:
    """The mean target of all others in the group."""
    sums = df.groupBy(*groups).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    joined = df.join(sums, list(groups)) if groups else df.crossJoin(F.broadcast(sums))
    return joined.withColumn(name, F.try_divide(F.col("_s") - F.col(y), F.col("_n") - 1)).drop("_s", "_n")


def fold_mean(df: DataFrame, y: str, fold: str, groups: Sequence[str] = (), name: str = "pred") -> DataFrame:
    """The mean target of the other folds."""
    own = df.groupBy(*groups, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row a fold
    rest = own.select(*groups, fold, F.try_divide(F.sum("_s").over(over) - F.col("_s"), F.sum("_n").over(over) - F.col("_n")).alias(name))
    return df.join(F.broadcast(rest), [*groups, fold])


def impute_by_fold(df: DataFrame, columns: Sequence[str], fold: str, use: str | None = None) -> DataFrame:
    """Gaps take the mean of the other folds' rows (those where `use` holds); a column without any value takes 0."""
    ok = F.col(use) if use else F.lit(True)
    pick = {c: F.when(ok, F.nanvl(F.col(c).cast("double"), F.lit(None))) for c in columns}
    own = df.groupBy(fold).agg(*[F.sum(e).alias(f"_s_{c}") for c, e in pick.items()], *[F.count(e).alias(f"_n_{c}") for c, e in pick.items()])
    over = Window.partitionBy(F.lit(0))  # a row a fold
    other = lambda c: F.sum(c).over(over) - F.coalesce(F.col(c), F.lit(0))
    rest = own.select(fold, *[F.coalesce(F.try_divide(other(f"_s_{c}"), other(f"_n_{c}")), F.lit(0.0)).alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(rest), fold).withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def _scale(x: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        mean, sd = np.nanmean(x[use], axis=0), np.nanstd(x[use], axis=0, ddof=1)
    return np.nan_to_num(mean), np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)


def _ridge_path(x: np.ndarray, y: np.ndarray, alphas: Sequence[float]) -> tuple[float, np.ndarray, float]:
    """Alpha of least closed-form leave-one-out error, its coefficients and intercept."""
    xm, ym = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - xm, full_matrices=False)
    uy = u.T @ (y - ym)
    best = (np.inf, alphas[0])
    for a in alphas:
        d = s * s / (s * s + a)
        left = 1 - 1 / len(y) - (u * u) @ d
        error = ((((y - ym) - u @ (d * uy)) / np.where(np.abs(left) > 1e-12, left, np.nan)) ** 2).mean()
        if error < best[0]:
            best = (error, a)
    w = vt.T @ (s / (s * s + best[1]) * uy)
    return best[1], w, ym - xm @ w


def _fit_ridge(x, y, options):
    _, w, b = _ridge_path(x, y, [options["alpha"]] if "alpha" in options else options.get("alphas", ALPHAS) if options.get("choose", True) else [1.0])
    return lambda z: z @ w + b


def _fit_log_ridge(x, y, options):
    good = y > 0
    inner = _fit_ridge(x[good], np.log(y[good]), options)
    return lambda z: np.exp(inner(z))


def _fit_ols(x, y, options):
    w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return lambda z: np.column_stack([np.ones(len(z)), z]) @ w


def _fit_mean(x, y, options):
    return lambda z: np.full(len(z), y.mean())


MODELS: dict[str, Callable] = {"mean": _fit_mean, "ols": _fit_ols, "ridge": _fit_ridge, "log_ridge": _fit_log_ridge}


def cross_validated(rows: DataFrame, who: str, target: str, columns: Sequence[str], model: str, groups: Sequence[str], use: str | None = None, options: Mapping | None = None, top: float | None = 100.0) -> DataFrame:
    """groups, who, true, pred for test rows. rows: one a (group, person) with a role column 'train' or 'test'.

    `groups` name the segment and fold: each is one independent fit in one task, features scaled on its training
    rows (those where `use` holds), gaps 0 after scaling. Fits with fewer than two rows give no prediction.
    """
    fields = [f for f in rows.schema.fields if f.name in (*groups, who)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", true double, pred double"
    fit = MODELS[model]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([who, "role"])
        train = (g["role"] == "train").to_numpy()
        x, y = g[list(columns)].to_numpy(float), g[target].to_numpy(float)
        ok = train & np.isfinite(y)
        base = ok & g[use].to_numpy(bool) if use else ok
        mean, sd = _scale(x, base if base.any() else ok)
        z = np.nan_to_num((x - mean) / sd, posinf=0, neginf=0)
        test = g[~train]
        pred = fit(z[ok], y[ok], options or {})(z[~train]) if ok.sum() >= 2 else np.full((~train).sum(), np.nan)
        return test[[f.name for f in fields]].assign(true=y[~train], pred=pred).replace({np.nan: None})

    out = rows.select(*[f.name for f in fields], "role", target, *([use] if use else []), *columns).groupBy(*groups).applyInPandas(run, schema)
    return out.withColumn("pred", clipped("pred", top)) if top is not None else out


def press(df: DataFrame, who: str, target: str, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """groups, who, true, pred: exact leave-one-out least squares by the hat matrix.

    One system a group comes from sums; leverages are then row arithmetic, so the people of a group may lie anywhere.
    Rows with gaps are left out. Null where X'X is singular or a row decides its own fit.
    """
    clean = df.dropna(subset=[target, *columns])
    return gram.predicted(clean, clean, who, target, columns, groups, left_out=True, strict=True)


def crossfit_ridge(rows: DataFrame, who: str, target: str, columns: Sequence[str], groups: Sequence[str], stratum: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """groups, who, true, pred: leave-one-out ridge whose alpha and scaling come from the other half of the segment.

    Halves are dealt in turn inside each stratum. Predictions are closed-form on all rows, so a segment costs two
    decompositions instead of one a person. Without three rows in the other half pred is null.
    """
    half = "_half"
    place = F.row_number().over(Window.partitionBy(*groups, stratum).orderBy(who))
    dealt = rows.dropna(subset=[target]).withColumn(half, ((place - 1) % 2).cast("int"))
    return gram.crossfitted(dealt, who, target, columns, groups, half, alphas).drop(half)


def tree_model(kind: str, seed: int = 42, depth: int = 6, trees: int = 200, least: int = 1, rate: float = 0.1, share: float | None = None):
    """Spark's distributed tree learners: 'tree', 'forest' or 'boosted'."""
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    if kind == "tree":
        return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=least, seed=seed)
    if kind == "forest":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=least, seed=seed)
    if kind == "boosted":
        return GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy=str(share or "all"), seed=seed)
    raise ValueError(f"unknown tree model {kind}")


def tree_predictions(train: DataFrame, test: DataFrame, target: str, columns: Sequence[str], kind: str = "forest", **options) -> DataFrame:
    """test rows with pred, by a distributed tree model; gaps count as 0."""
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=list(columns), outputCol="_x")
    ready = lambda df: assembler.transform(df.fillna(0.0, subset=list(columns)))
    model = tree_model(kind, **options).setFeaturesCol("_x").setLabelCol(target).setPredictionCol("pred").fit(ready(train))
    return model.transform(ready(test)).drop("_x")


def combined_segments(preds: DataFrame, who: str, first: Sequence[str] = ()) -> DataFrame:
    """One row a participant: the mean prediction over the segments that hold them."""
    return preds.groupBy(who).agg(F.avg("pred").alias("pred"), F.min("true").alias("true"), *[F.min(c).alias(c) for c in first])


def residual(true: str = "true", pred: str = "pred") -> Column:
    return F.col(pred) - F.col(true)
