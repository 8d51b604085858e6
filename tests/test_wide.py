"""Least squares and ridge on many columns from blocked sums, against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import features, gram, models, schemes


def wide(spark, n, k, seed=1, gaps=0.0, tasks=4):
    """who, item, fold, y, x0 ...; the arrays beside."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ np.diag(rng.uniform(0.5, 3, k)) + rng.normal(size=k)
    y = x[:, :3] @ np.array([1.0, -2.0, 0.5])[: x[:, :3].shape[1]] + rng.normal(size=n)
    if gaps:
        x[rng.random(x.shape) < gaps] = np.nan
    who = np.arange(n)
    data = [(int(w), int(w % 4), int(w // 4 % 3), float(t), [float(v) for v in row]) for w, t, row in zip(who, y, x, strict=True)]
    df = spark.createDataFrame(data, "who long, item int, fold int, y double, x array<double>").repartition(tasks)
    names = [f"x{j}" for j in range(k)]
    return df.select("who", "item", "fold", "y", *[F.col("x")[j].alias(c) for j, c in enumerate(names)]), names, x, y


def plain(x, y, z, alphas):
    """Prediction of z, trained on all rows of x; the alpha of least leave-one-out error, by leaving each row out."""
    mean, sd = models._scale(x, np.ones(len(x), bool))
    fill = lambda v: np.nan_to_num((v - mean) / sd, posinf=0, neginf=0)
    a, b = fill(x), fill(z)

    def fit(rows, target, alpha):
        middle = rows.mean(axis=0)
        c = rows - middle
        w = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ (target - target.mean()))
        return lambda v: target.mean() + (v - middle) @ w

    def error(alpha):
        rest = [np.arange(len(y)) != i for i in range(len(y))]
        return sum((fit(a[r], y[r], alpha)(a[[i]])[0] - y[i]) ** 2 for i, r in enumerate(rest))

    alpha = min(alphas, key=error) if len(alphas) > 1 else alphas[0]
    return fit(a, y, alpha)(b)


@pytest.mark.parametrize("k,block,gaps", [(10, 4, 0.1), (60, 64, 0.0), (60, 7, 0.05)])
def test_folds_equal_fits_on_rows(spark, monkeypatch, k, block, gaps):
    monkeypatch.setattr(gram, "BLOCK", block)
    df, names, x, y = wide(spark, 90, k, gaps=gaps)
    alphas = (0.1, 10.0, 1000.0)
    got = {r["who"]: r["pred"] for r in schemes.predicted_by_fold(df, "who", "y", names, "fold", alphas=alphas).collect()}
    assert len(got) == 90
    fold = np.arange(90) // 4 % 3
    for f in range(3):
        want = plain(x[fold != f], y[fold != f], x[fold == f], alphas)
        assert np.allclose([got[i] for i in np.flatnonzero(fold == f)], want, rtol=1e-6)


def test_items_honour_the_model(spark):
    df, names, x, y = wide(spark, 72, 10, seed=4)
    alphas = (0.01, 1.0, 100.0)
    who = np.arange(72)
    item, fold = who % 4, who // 4 % 3
    unseen = {r["who"]: r["pred"] for r in schemes.per_item(df, "who", "y", names, "item", "UNSEEN", model="ridge", alphas=alphas).collect()}
    seen = {r["who"]: r["pred"] for r in schemes.per_item(df, "who", "y", names, "item", "SEEN", model="ridge", alphas=alphas).collect()}
    for i in (0, 7, 30, 71):
        rest = (item != item[i]) & (fold != fold[i])
        assert np.isclose(unseen[i], plain(x[rest], y[rest], x[[i]], alphas)[0])
    for t in range(4):
        own = np.flatnonzero(item == t)
        mean, sd = models._scale(x[own], np.ones(len(own), bool))
        z = (x[own] - mean) / sd

        def left_out(alpha, z=z, own=own):
            out = []
            for i in range(len(own)):
                r = np.arange(len(own)) != i
                m = z[r].mean(axis=0)
                w = np.linalg.solve((z[r] - m).T @ (z[r] - m) + alpha * np.eye(10), (z[r] - m).T @ (y[own][r] - y[own][r].mean()))
                out.append(y[own][r].mean() + (z[i] - m) @ w)
            return np.array(out)

        best = min(alphas, key=lambda a: ((left_out(a) - y[own]) ** 2).sum())
        assert np.allclose([seen[i] for i in own], left_out(best))
    with pytest.raises(ValueError, match="forest"):
        schemes.per_item(df, "who", "y", names, "item", "SEEN", model="forest")


def test_crossfit_takes_scale_and_alpha_from_the_other_half(spark):
    df, names, x, y = wide(spark, 40, 5, seed=6, gaps=0.1)
    alphas = (0.1, 5.0, 500.0)
    got = {r["who"]: r["pred"] for r in models.crossfit_ridge(df, "who", "y", names, ["item"], "fold", alphas).collect()}
    who = np.arange(40)
    for t in range(4):
        own = who[who % 4 == t]
        half = np.zeros(len(own), int)
        for f in range(3):
            at = np.flatnonzero(own // 4 % 3 == f)
            half[at] = np.arange(len(at)) % 2
        for h in (0, 1):
            other = half != h
            mean, sd = models._scale(x[own], other)
            z = np.nan_to_num((x[own] - mean) / sd)
            alpha = models._ridge_path(z[other], y[own][other], alphas)[0]
            for i in np.flatnonzero(half == h):
                r = np.arange(len(own)) != i
                m = z[r].mean(axis=0)
                w = np.linalg.solve((z[r] - m).T @ (z[r] - m) + alpha * np.eye(5), (z[r] - m).T @ (y[own][r] - y[own][r].mean()))
                assert np.isclose(got[own[i]], y[own][r].mean() + (z[i] - m) @ w)


def test_three_hundred_columns_in_one_plan(spark):
    df, names, x, y = wide(spark, 1500, 300, tasks=4)
    plans = [len(gram.sums_by(df, ["fold"], "y", names[:k])._jdf.queryExecution().optimizedPlan().toString()) for k in (30, 300)]
    assert plans[1] < 15 * plans[0]
    got = {r["who"]: r["pred"] for r in schemes.predicted_by_fold(df, "who", "y", names, "fold", model="ols").collect()}
    fold = np.arange(1500) // 4 % 3
    one = np.column_stack([np.ones(1500), x])
    w = np.linalg.lstsq(one[fold != 1], y[fold != 1], rcond=None)[0]
    assert np.allclose([got[i] for i in np.flatnonzero(fold == 1)], one[fold == 1] @ w, rtol=1e-5, atol=1e-6)


def test_slices_of_systems_give_every_row_once(spark, monkeypatch):
    df, names, _, _ = wide(spark, 60, 4)
    whole = sorted(map(tuple, schemes.predicted_by_fold(df, "who", "y", names, "who").collect()))
    monkeypatch.setattr(gram, "SHARED_BYTES", 2000)
    monkeypatch.setattr(gram, "HELD_BYTES", 100)
    parts = sorted(map(tuple, schemes.predicted_by_fold(df, "who", "y", names, "who").collect()))
    assert len(parts) == 60 and np.allclose(np.array(whole, float), np.array(parts, float))


def test_gaps_nulls_and_what_cannot_be_fitted(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0, None), (2, "a", None, 2.0, 3.0), (3, "b", 3.0, float("nan"), 1.0), (4, None, 4.0, 4.0, 4.0), (5, "b", float("nan"), 1.0, 2.0)], "who long, g string, y double, p double, q double")
    got = {r["who"]: r for r in schemes.predicted_by_fold(df, "who", "y", ["p", "q"], "g", model="ols").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2]["true"] is None and got[5]["true"] is None
    assert gram.predicted(df.limit(0), df, "who", "y", ["p"]).where("pred is null").count() == 5
    assert models.press(df.limit(0), "who", "y", ["p"]).count() == 0
    pair = models.press(spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0)], "who long, y double, p double"), "who", "y", ["p"]).collect()
    assert [r["pred"] for r in pair] == [None, None]


def test_coefficients_of_many_columns(spark):
    df, names, x, y = wide(spark, 120, 12, seed=8)
    short = df.withColumn("item", F.when(F.col("who") < 5, 9).otherwise(F.col("item")))  # item 9: five rows
    got = {r["item"]: r for r in features.linear_coefficients(short, ["item"], "y", names).collect()}
    who = np.arange(120)
    for t in range(4):
        at = (who % 4 == t) & (who >= 5)
        want = np.linalg.lstsq(np.column_stack([np.ones(at.sum()), x[at]]), y[at], rcond=None)[0]
        assert got[t]["n_rows"] == at.sum() and np.allclose([got[t][c] for c in ["b_0", *(f"b_{n}" for n in names)]], want)
    assert got[9]["n_rows"] == 5 and got[9]["b_0"] is None
    plans = [len(features.linear_coefficients(df, ["item"], "y", names[:k])._jdf.queryExecution().optimizedPlan().toString()) for k in (9, 12)]
    assert plans[1] < 1.5 * plans[0]
