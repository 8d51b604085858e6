"""Taking a language-distance bias out of scores. Fits are grouped sums; folds are keys, not loops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.special import correlation_t, f_p_value, t_p_value
from fovea.operators import resampling
from fovea.operators.features import linear_coefficients
from fovea.operators.stats import pearson


def prepared(scores: DataFrame, distances: DataFrame, target: str, lang: str = "L1", missing: float = -1.0) -> DataFrame:
    """Scores with their language's distance; rows whose target wasn't taken or whose distance is unknown go."""
    return scores.join(distances.select(lang, "distance"), lang, "left").where(F.col(target).isNotNull() & (F.col(target) != missing) & F.col("distance").isNotNull())


def residuals(df: DataFrame, y: str, x: str, groups: Sequence[str] = (), name: str = "residual") -> DataFrame:
    """y less its regression on x, inside each group."""
    over = Window.partitionBy(*groups) if groups else None
    if over is not None:
        return df.withColumn(name, F.col(y) - F.regr_intercept(y, x).over(over) - F.regr_slope(y, x).over(over) * F.col(x))
    fit = df.agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    return df.crossJoin(F.broadcast(fit)).withColumn(name, F.col(y) - F.col("_i") - F.col("_s") * F.col(x)).drop("_s", "_i")


def _sums(score: str, target: str) -> dict[str, Column]:
    """The sums that a two-step fit needs; sums of folds subtract."""
    y, t, d = (F.col(c).cast("double") for c in (score, target, "distance"))
    return {"n": F.count(F.lit(1)).cast("double"), "y": F.sum(y), "t": F.sum(t), "d": F.sum(d), "yy": F.sum(y * y), "tt": F.sum(t * t), "dd": F.sum(d * d), "yt": F.sum(y * t), "yd": F.sum(y * d), "td": F.sum(t * d)}


def _centred(n: str, a: str, b: str, ab: str) -> Column:
    return F.col(ab) - F.col(a) * F.col(b) / F.col(n)


def _two_step(prefix: str = "") -> Column:
    """Slope of (score less its line on target) on distance, from sums."""
    c = lambda a, b, ab: _centred(f"{prefix}n", f"{prefix}{a}", f"{prefix}{b}", f"{prefix}{ab}")
    slope = F.try_divide(c("y", "t", "yt"), c("t", "t", "tt"))
    return F.try_divide(c("y", "d", "yd") - slope * c("t", "d", "td"), c("d", "d", "dd"))


def _partial(prefix: str = "") -> Column:
    """Coefficient on distance of score ~ target + distance, from sums."""
    c = lambda a, b, ab: _centred(f"{prefix}n", f"{prefix}{a}", f"{prefix}{b}", f"{prefix}{ab}")
    tt, dd, td = c("t", "t", "tt"), c("d", "d", "dd"), c("t", "d", "td")
    return F.try_divide(c("y", "d", "yd") * tt - c("y", "t", "yt") * td, tt * dd - td * td)


FITS = {"two_step": _two_step, "distance_mreg": _partial}


def alpha(df: DataFrame, score: str, target: str, groups: Sequence[str] = (), how: str = "two_step") -> DataFrame:
    """groups, n, alpha, mean_distance; null for fewer than 3 rows or 2 languages."""
    sums = df.groupBy(*groups).agg(*[c.alias(k) for k, c in _sums(score, target).items()], F.countDistinct("distance").alias("langs"))
    return sums.select(*groups, F.col("n").cast("long").alias("n"), F.when((F.col("n") >= 3) & (F.col("langs") >= 2), FITS[how]()).alias("alpha"), (F.col("d") / F.col("n")).alias("mean_distance"))


def corrected(score: str | Column, alpha: str | Column, centre: str | Column | float = 0.0) -> Column:
    """score - alpha * (distance - centre)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)
    return col(score) - col(alpha) * (F.col("distance") - col(centre))


def debias_by_fold(df: DataFrame, score: str, target: str, fold: str, how: str = "two_step", centre: bool = False, groups: Sequence[str] = ()) -> DataFrame:
    """Every row corrected by the alpha of all rows of its groups outside its fold: all sums less the fold's own.

    With the language as the fold this is the across-languages scheme, with stratified folds the inside one.
    """
    names, keys = list(_sums(score, target)), [*groups, fold]
    own = df.groupBy(*keys).agg(*[c.alias(k) for k, c in _sums(score, target).items()])
    by = Window.partitionBy(*(groups or [F.lit(0)]))  # a row a fold: languages or a few strata
    left = own.select(*keys, *[(F.sum(k).over(by) - F.col(k)).alias(k) for k in names])
    fits = left.select(*keys, F.when(F.col("n") >= 3, FITS[how]()).alias("alpha"), (F.col("d") / F.col("n")).alias("_centre"))
    return df.join(fits, keys).withColumn("debiased", corrected(score, "alpha", "_centre" if centre else 0.0)).drop("_centre")


def interaction_by_fold(df: DataFrame, score: str, target: str, fold: str, centre: bool = False) -> DataFrame:
    """Every row corrected by the main effect of distance in score ~ t + d + t * d (both centred), fitted outside its fold.

    The fit is on uncentred sums, all less the fold's own; the centred main effect is b_d + b_td * mean t.
    """
    y, t, d = (F.col(c).cast("double") for c in (score, target, "distance"))
    terms = (F.lit(1.0), t, d, t * d)
    sums = {f"m{i}_{j}": F.sum(a * b) for i, a in enumerate(terms) for j, b in enumerate(terms)} | {f"r{i}": F.sum(a * y) for i, a in enumerate(terms)}
    own = df.groupBy(fold).agg(*[v.alias(k) for k, v in sums.items()])
    by = Window.partitionBy(F.lit(0))  # a row a fold
    left = own.select(fold, *[(F.sum(k).over(by) - F.col(k)).alias(k) for k in sums])

    def solve(batches):
        for g in batches:
            m = g[[f"m{i}_{j}" for i in range(4) for j in range(4)]].to_numpy(float).reshape(-1, 4, 4)
            r = g[[f"r{i}" for i in range(4)]].to_numpy(float)
            out = []
            for a, b in zip(m, r, strict=True):
                good = a[0, 0] >= 4 and np.linalg.matrix_rank(a / np.sqrt(np.outer(np.diag(a), np.diag(a)) + 1e-300)) == 4
                w = np.linalg.solve(a, b) if good else np.full(4, np.nan)
                out.append((w[2] + w[3] * a[0, 1] / a[0, 0] if good else None, a[0, 2] / a[0, 0] if a[0, 0] else None))
            yield pd.DataFrame({fold: g[fold].to_numpy(), "alpha": [x for x, _ in out], "_centre": [c for _, c in out]})

    fits = left.mapInPandas(solve, f"`{fold}` {dict(df.dtypes)[fold]}, alpha double, _centre double")
    return df.join(F.broadcast(fits), fold).withColumn("debiased", corrected(score, "alpha", "_centre" if centre else 0.0)).drop("_centre")


def interaction(df: DataFrame, score: str, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b_0, b_t, b_d, b_td of score ~ t + d + t * d, with target and distance centred in the group."""
    by = Window.partitionBy(*(groups or [F.lit(0)]))
    centred = df.withColumns({"t": F.col(target) - F.avg(target).over(by), "d": F.col("distance") - F.avg("distance").over(by)}).withColumn("td", F.col("t") * F.col("d"))
    return linear_coefficients(centred, groups, score, ["t", "d", "td"])


def _effects(n: np.ndarray, my: np.ndarray, mt: np.ndarray, stt: np.ndarray, sty: np.ndarray, syy: np.ndarray, how: str) -> np.ndarray:
    """What each language adds, from its count, means and sums of squares and products inside it; effects sum to zero."""
    slope = sty.sum() / stt.sum() if len(n) and stt.sum() > 0 else 0.0
    remainder = my - slope * mt
    if how == "random" and len(n) > 2:
        within = max(1e-12, (syy.sum() - slope * sty.sum()) / max(1.0, n.sum() - len(n) - 1))
        design = np.column_stack([np.ones(len(n)), mt])
        line = np.linalg.lstsq(design, my, rcond=None)[0]
        between = max(0.0, float(((my - design @ line) ** 2).sum() / (len(n) - 2) - within / (len(n) / (1 / n).sum())))
        weight = 1 / (between + within / n)
        line = np.linalg.lstsq(design * np.sqrt(weight)[:, None], my * np.sqrt(weight), rcond=None)[0]
        remainder = between / (between + within / n) * (my - design @ line)
    return remainder - remainder.mean() if len(n) else remainder


def language_effects(df: DataFrame, score: str, target: str, lang: str = "L1", how: str = "fixed") -> DataFrame:
    """lang, n, effect: what a language adds to the score at equal target, effects summing to zero.

    'fixed': the within-language slope, then the language's mean remainder. 'random': that remainder shrunk by
    between and within variance (Swamy and Arora). Sums by language are Spark's; a row a language is solved here.
    """
    y, t = F.col(score), F.col(target)
    rows = df.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(t).alias("mt"), F.regr_sxx(y, t).alias("stt"), F.regr_sxy(y, t).alias("sty"), F.regr_syy(y, t).alias("syy")).orderBy(lang)
    got = rows.collect()  # one row a language
    effect = _effects(*(np.array([float(r[c] or 0.0) for r in got]) for c in ("n", "my", "mt", "stt", "sty", "syy")), how)
    return df.sparkSession.createDataFrame([(r[lang], int(r["n"]), float(e)) for r, e in zip(got, effect, strict=True)], f"`{lang}` string, n long, effect double")


def effects_by_fold(df: DataFrame, score: str, target: str, fold: str, lang: str = "L1", how: str = "fixed") -> DataFrame:
    """Every row with `effect`, its language's effect learned on the rows outside its fold, and `debiased`; null for a
    language that only the fold has.

    Sums by language and fold; a fold's are all less its own. A task solves folds of a row a language each.
    """
    y, t = F.col(score).cast("double"), F.col(target).cast("double")
    names = ("n", "y", "t", "yy", "tt", "yt")
    own = df.groupBy(lang, fold).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(t).alias("t"), F.sum(y * y).alias("yy"), F.sum(t * t).alias("tt"), F.sum(y * t).alias("yt"))
    whole = own.groupBy(lang).agg(*[F.sum(c).alias(f"a_{c}") for c in names])
    every = whole.crossJoin(F.broadcast(own.select(fold).distinct())).join(own, [lang, fold], "left")  # a row a language and fold
    left = every.select(lang, fold, *[(F.col(f"a_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in names]).where("n > 0")
    kinds = dict(df.dtypes)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(lang)
        n, sy, st, yy, tt, yt = (g[c].to_numpy(float) for c in names)
        effect = _effects(n, sy / n, st / n, tt - st * st / n, yt - sy * st / n, yy - sy * sy / n, how)
        return g[[lang, fold]].assign(effect=effect)

    effects = left.groupBy(fold).applyInPandas(solve, f"`{lang}` {kinds[lang]}, `{fold}` {kinds[fold]}, effect double")
    return df.join(effects, [lang, fold], "left").withColumn("debiased", F.col(score) - F.col("effect"))


def without_effects(df: DataFrame, effects: DataFrame, score: str, lang: str = "L1") -> DataFrame:
    """Scores less their language's effect; null for a language without one."""
    return df.join(F.broadcast(effects.select(lang, "effect")), lang, "left").withColumn("debiased", F.col(score) - F.col("effect")).drop("effect")


def delta_r_bootstrap(df: DataFrame, score: str, target: str, groups: Sequence[str], lang: str = "L1", centre: bool = True, draws: int = 10_000, seed: int = 42, statistic: str = "r", who: str | None = None) -> DataFrame:
    """groups, n, r_raw, r_debiased, delta_r, low, high, p: what debiasing does to the correlation with the target, or
    (statistic 'b', columns b_...) to the two-step slope on distance.

    `lang` is the fold that is left out: the language, or a stratified fold. Each draw reweights people and refits
    every fold's alpha from the sums of the others; the corrected scores' sums follow from the fold's, so no row is
    read twice. p doubles the smaller tail of the draws centred on no change, at least 1 / draws. `who` as in
    `stats.bootstrap`. Null under six rows or three folds.
    """
    values = [score, target, "distance"]
    rows = resampling.usable(df, values).where(F.col(lang).isNotNull())
    rows = rows.select(*groups, lang, *values, resampling.row_key([*groups, lang], values, who).alias("_row"))
    rows = resampling.centred(rows, groups, [score, target])
    y, t, d = F.col(f"_c_{score}"), F.col(f"_c_{target}"), F.col("distance").cast("double")
    terms = [F.lit(1.0), y, t, d, y * y, t * t, d * d, y * t, y * d, t * d]

    def finish(held: np.ndarray) -> list:
        own = dict(zip(("n", "y", "t", "d", "yy", "tt", "dd", "yt", "yd", "td"), held.transpose(1, 0, 2), strict=True))
        n = int(own["n"][:, 0].sum())
        if len(held) < 3 or n < 6:
            return [n, *[None] * 6]
        total = {k: v.sum(axis=0) for k, v in own.items()}
        rest = {k: total[k] - v for k, v in own.items()}
        with np.errstate(all="ignore"):
            c = lambda s, a, b, ab: s[ab] - s[a] * s[b] / s["n"]
            slope = lambda s: (c(s, "y", "d", "yd") - c(s, "y", "t", "yt") / c(s, "t", "t", "tt") * c(s, "t", "d", "td")) / c(s, "d", "d", "dd")
            alpha = np.where(own["n"] > 0, slope(rest), 0.0)  # a fold without anybody in a draw corrects nobody
            middle = np.where(own["n"] > 0, rest["d"] / rest["n"], 0.0) if centre else 0.0
            moved = {"y": own["d"] - middle * own["n"], "yt": own["td"] - middle * own["t"], "yd": own["dd"] - middle * own["d"]}
            fixed = total | {k: (own[k] - alpha * m).sum(axis=0) for k, m in moved.items()}
            square = own["dd"] - 2 * middle * own["d"] + middle * middle * own["n"]
            fixed["yy"] = (own["yy"] - 2 * alpha * (own["yd"] - middle * own["y"]) + alpha * alpha * square).sum(axis=0)
            r = lambda s: resampling.correlation(s["n"], s["y"], s["t"], s["yy"], s["tt"], s["yt"])
            raw, after = (slope(total), slope(fixed)) if statistic == "b" else (r(total), r(fixed))
        gain, delta = after[0] - raw[0], (after - raw)[1:]
        delta = delta[np.isfinite(delta)]
        if not len(delta) or not np.isfinite(gain):
            return [n, *[None] * 6]
        p = 2 * min((delta - gain >= gain).mean(), (delta - gain <= gain).mean())
        return [n, raw[0], after[0], gain, *np.percentile(delta, [2.5, 97.5]), min(1.0, max(1 / draws, p))]

    names = ["n", f"{statistic}_raw", f"{statistic}_debiased", f"delta_{statistic}", "low", "high", "p"]
    sums = resampling.weighted_sums(rows, [*groups, lang], F.col("_row"), terms, draws, seed)
    return resampling.finished(sums, groups, len(terms), [lang], names, finish)


def slope_test(df: DataFrame, y: str, x: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, slope, r, p (t test of the slope)."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), pearson(x, y).alias("r"))
    return out.withColumn("p", t_p_value(correlation_t(F.col("r"), F.col("n")), (F.col("n") - 2).cast("double")))


def language_anova(df: DataFrame, value: str, lang: str = "L1", groups: Sequence[str] = ()) -> DataFrame:
    """groups, langs, n, f, p of one-way differences between languages."""
    by = df.where(F.col(value).isNotNull()).groupBy(*groups, lang).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    s = by.groupBy(*groups).agg(F.count(F.lit(1)).alias("langs"), F.sum("n").alias("n"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    f = F.try_divide(F.col("between") / (F.col("langs") - 1), F.col("within") / (F.col("n") - F.col("langs")))
    out = s.select(*groups, "langs", "n", F.when((F.col("langs") > 1) & (F.col("n") > F.col("langs")), f).alias("f"))
    return out.withColumn("p", f_p_value("f", (F.col("langs") - 1).cast("double"), (F.col("n") - F.col("langs")).cast("double")))


def language_summary(df: DataFrame, value: str, lang: str = "L1") -> DataFrame:
    """lang, n, mean value, distance."""
    return df.groupBy(lang).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.min("distance").alias("distance"))


def missing_variants(present: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected result cells that nobody has produced."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


@dataclass(frozen=True)
class Correction:
    """A way to correct scores: name, method (FITS, 'interaction', 'fixed' or 'random'), fold column, what it needs, whom
    it leaves out, and a target of its own if it has one."""

    name: str
    method: str
    fold: str
    target: str | None = None
    skip_for: frozenset = frozenset()
    centre: bool = False


def apply_correction(df: DataFrame, correction: Correction, score: str, target: str, feature_set: str, lang: str = "L1") -> DataFrame | None:
    """The rows with `debiased`, or None where the correction leaves the feature set out or a column it needs is missing."""
    target = correction.target or target
    needs = {correction.fold, target, score} | ({lang} if correction.method in ("fixed", "random") else {"distance"})
    if feature_set in correction.skip_for or not needs <= set(df.columns):
        return None
    if correction.method in ("fixed", "random"):
        return effects_by_fold(df, score, target, correction.fold, lang, correction.method)
    if correction.method == "interaction":
        return interaction_by_fold(df, score, target, correction.fold, correction.centre)
    return debias_by_fold(df, score, target, correction.fold, correction.method, correction.centre)


def all_corrections(df: DataFrame, corrections: Sequence[Correction], who: str, score: str, target: str, feature_set: str) -> DataFrame:
    """who, variant, score: the raw score and every correction that applies, one below the other."""
    out = df.select(who, F.lit("raw").alias("variant"), F.col(score).alias("score"))
    for c in corrections:
        found = apply_correction(df, c, score, target, feature_set)
        if found is not None:
            out = out.unionByName(found.select(who, F.lit(c.name).alias("variant"), F.col("debiased").alias("score")))
    return out


def bias_summary(df: DataFrame, score: str, target: str, cells: Sequence[str]) -> DataFrame:
    """cells, n, alpha (two-step slope on distance), r and slope of the score's remainder against distance: a sweep over
    result cells (entry, target, kind of distance) is one job over their key."""
    found = residuals(df.where(F.col(score).isNotNull() & F.col(target).isNotNull() & F.col("distance").isNotNull()), score, target, cells)
    return found.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("residual", "distance").alias("alpha"), pearson("residual", "distance").alias("r"))
