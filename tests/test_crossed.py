"""Variances from grouped sums, against the likelihood of the whole covariance matrix and balanced mean squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import crossed, reliability


def cells(n, k, seed, gaps=0.2, groups=2):
    rng = np.random.default_rng(seed)
    person, item = rng.normal(0, 2, n), rng.normal(0, 1, (groups, k))
    return [(int(p), int(i + 100 * (p % groups)), f"g{p % groups}", float(person[p] + item[p % groups, i] + 3 * (p % groups) + rng.normal(0, 1.5))) for p in range(n) for i in range(k) if rng.random() >= gaps]


def likelihood(rows, x, va, vb, ve):
    """Restricted log likelihood, up to a constant, from the dense covariance matrix."""
    who, item, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    v = va * (who[:, None] == who[None, :]) + vb * (item[:, None] == item[None, :]) + ve * np.eye(len(y))
    inverse = np.linalg.inv(v)
    left = x.T @ inverse @ x
    beta = np.linalg.solve(left, x.T @ inverse @ y)
    r = y - x @ beta
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(left)[1] + r @ inverse @ r)


def dummies(values):
    return (np.array(values)[:, None] == np.unique(values)[None, :]).astype(float)


def test_variances_are_at_the_top_of_the_likelihood(spark):
    rows = cells(30, 6, 4)
    df = spark.createDataFrame(rows, "who long, item long, g string, value double").repartition(4)
    for groups, pick in ((["g"], lambda g: [r for r in rows if r[2] == g]), ([], lambda _: rows)):
        for r in reliability.icc_crossed_reml(df, "who", "item", "value", groups, rounds=5000).collect():
            own = pick(r["g"] if groups else None)
            at = (r["var_person"], r["var_item"], r["var_error"])
            one = np.ones((len(own), 1))
            best = likelihood(own, one, *at)
            for j in range(3):
                for factor in (0.97, 1.03):
                    assert likelihood(own, one, *(v * (factor if i == j else 1) for i, v in enumerate(at))) < best
            assert np.isclose(r["icc"], at[0] / sum(at))


def test_pooled_coefficients_hold_the_groups_levels(spark):
    rows = cells(40, 5, 9, gaps=0.1)
    df = spark.createDataFrame(rows, "who long, item long, g string, value double").repartition(4)
    got = reliability.icc_pooled_mixed(df, "who", "item", "value", "g", rounds=5000).first()
    found = [(n, np.frombuffer(p, np.float64)) for n, p in crossed.sums(reliability.one_per_cell(df, "who", "item", "value", ["g"]), "who", "item", (), "g").select("_cells", "payload").collect()]
    two, three = crossed.variances(found, 2, 10, True, 5000), crossed.variances(found, 2, 10, False, 5000)
    by_group, by_item = dummies([r[2] for r in rows]), dummies([r[1] for r in rows])
    for x, at in ((by_group, two), (by_item, (three[0], 0.0, three[2]))):
        best = likelihood(rows, x, *at)
        for j in (0, 1, 2):
            for factor in (0.97, 1.03) if at[j] else ():
                assert likelihood(rows, x, *(v * (factor if i == j else 1) for i, v in enumerate(at))) < best
    k = round(len(rows) / len({r[0] for r in rows}))
    assert np.allclose(list(got), [two[0] / sum(two), three[0] / (three[0] + three[2]), two[0] / (two[0] + (two[1] + two[2]) / k), three[0] / (three[0] + three[2] / k)])


def test_balanced_tables_give_the_mean_squares(spark):
    rows = cells(25, 4, 2, gaps=0.0, groups=1)
    df = spark.createDataFrame(rows, "who long, item long, g string, value double")
    want = reliability.icc(df, "who", "item", "value").first()
    got = reliability.icc_pooled_mixed(df, "who", "item", "value", "g", rounds=20000).first()
    assert got["icc2"] == pytest.approx(want["icc2"], abs=2e-4) and got["icc3"] == pytest.approx(want["icc3"], abs=2e-4)
    assert got["icc2k"] == pytest.approx(want["icc2k"], abs=2e-4) and got["icc3k"] == pytest.approx(want["icc3k"], abs=2e-4)


def test_undetermined_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "one", 1.0), (2, 1, "one", 2.0), (1, 1, "flat", 3.0), (1, 2, "flat", 3.0), (2, 1, "flat", 3.0), (2, 2, "flat", 3.0), (3, 1, "flat", 3.0), (3, 2, "flat", None)], "who long, item long, g string, value double")
    got = {r["g"]: r["icc"] for r in reliability.icc_crossed_reml(df, "who", "item", "value", ["g"]).collect()}
    assert got == {"one": None, "flat": None}
    assert reliability.icc_crossed_reml(df.limit(0), "who", "item", "value", ["g"]).count() == 0
    assert df.select(F.lit(1)).count() == 8
