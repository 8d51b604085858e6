"""Discriminative scores from rounds of sums, against fits on each fold's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import discriminants, scoring
from fovea.operators.features import logistic_fit


def balanced_logistic(x, y):
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [float(x.shape[1] - 1)] * (x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
    return w


def lda(x, y):
    """With the published noise term: the mean squared distance of each row's outer product from the covariance."""
    z = x[:, 1:]
    a, b = z[y == 1].mean(axis=0), z[y == 0].mean(axis=0)
    c = z - np.where(y[:, None] == 1, a, b)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n / n / p
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    shrink = min(1.0, noise / spread)
    w = np.linalg.solve((1 - shrink) * s + shrink * mu * np.eye(p), a - b)
    return np.concatenate([[-(a + b) @ w / 2 + np.log(y.mean() / (1 - y.mean()))], w])


PLAIN = {"logistic": balanced_logistic, "lda": lda, "plain_logistic": logistic_fit}


def people(n, seed, groups="ab", gaps=0.1):
    rng = np.random.default_rng(seed)
    native = rng.random(n) < 0.4
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + native[:, None] * [0.8, 2.0, 0.1] + [3, -7, 100]
    x[rng.random(x.shape) < gaps] = np.nan
    return [(int(i), groups[i % len(groups)], float(native[i]), int(i // 2 % 4), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]


def plain(train, test, how):
    """Scores of test rows by a fit on train rows, each (label, features)."""
    x, y, t = (np.array(v, float) for v in ([r[1] for r in train], [r[0] for r in train], [r[1] for r in test]))
    if len(set(y)) < 2:
        return [None] * len(t)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0, ddof=1)
    z = lambda v: np.column_stack([np.ones(len(v)), np.nan_to_num((v - mean) / sd)])
    w = PLAIN[how](z(x), y)
    return [None] * len(t) if w is None else z(t) @ w


SCHEMA = "who long, g string, native double, fold int, a double, b double, c double"


@pytest.mark.parametrize("how", list(PLAIN))
def test_out_of_fold_scores_equal_fits_on_rows(spark, how):
    data = people(160, 3)
    got = {r["who"]: r["eye_score"] for r in scoring.discriminative_scores(spark.createDataFrame(data, SCHEMA).repartition(5), "who", "native", "fold", ["a", "b", "c"], ["g"], how).collect()}
    assert len(got) == 160
    for g in "ab":
        for f in range(4):
            own = [r for r in data if r[1] == g]
            test = [r for r in own if r[3] == f]
            want = plain([(r[2], r[4:]) for r in own if r[3] != f], [(r[2], r[4:]) for r in test], how)
            assert np.allclose([got[r[0]] for r in test], want, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("shared", [True, False])
def test_paired_scores_equal_fits_without_the_targets_people(spark, shared):
    natives, fit = [r for r in people(80, 5) if r[2] == 1], [r for r in people(120, 6) if r[2] == 0]
    target = [(r[0] + (0 if shared else 1000), *r[1:4], *(None if v is None else v + 0.1 for v in r[4:])) for r in fit]
    frames = [spark.createDataFrame(d, SCHEMA) for d in (natives, fit, target)]
    got = {r["who"]: r["eye_score"] for r in scoring.paired_scores(*frames, "who", "fold", ["a", "b", "c"], ["g"]).collect()}
    assert set(got) == {r[0] for r in target}
    for g in "ab":
        for f in range(4):
            test = [r for r in target if r[1] == g and r[3] == f]
            gone = {r[0] for r in test}
            train = [(1.0, r[4:]) for r in natives if r[1] == g] + [(0.0, r[4:]) for r in fit if r[1] == g and r[0] not in gone]
            assert np.allclose([got[r[0]] for r in test], plain(train, [(0, r[4:]) for r in test], "logistic"), rtol=1e-5)


def test_one_class_separated_and_empty(spark):
    rows = [(k, "one", 1.0, k % 2, float(k), 1.0, None) for k in range(6)] + [(10 + k, "apart", float(k > 5), k % 2, float(k), float(k % 3), 2.0) for k in range(12)] + [(40 + k, "fine", float(k % 2), k // 3 % 2, float(k % 5), float("inf") if k == 3 else float(k % 7), None) for k in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    score = lambda d, how: {r["who"]: r["eye_score"] for r in scoring.discriminative_scores(d, "who", "native", "fold", ["a", "b", "c"], ["g"], how).collect()}
    usual, likeliest = score(df, "logistic"), score(df, "plain_logistic")
    assert all(usual[k] is None for k in range(6)) and all(usual[10 + k] is not None for k in range(12)) and all(usual[40 + k] is not None for k in range(24))
    assert all(likeliest[10 + k] is None for k in range(12))
    assert score(df.limit(0), "lda") == {}
    assert set(discriminants.FITS) == set(PLAIN)


def test_rows_are_not_gathered(spark):
    df = spark.createDataFrame(people(40, 8), SCHEMA)
    plan = scoring.discriminative_scores(df, "who", "native", "fold", ["a", "b", "c"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "SinglePartition" not in plan
    assert df.select(F.max("who")).first()[0] == 39
