"""Ridge on long rows, against ridge on columns and against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import gram, kernel, models

ALPHAS = (0.1, 3.0, 100.0)


def long_rows(spark, n, k, seed=3, gaps=0.2, groups=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * rng.uniform(0.5, 4, k)
    y = x[:, :2].sum(axis=1) + rng.normal(size=n)
    x[rng.random(x.shape) < gaps] = np.nan
    people = [(int(i % groups), int(i), float(y[i]), int(i // groups % 3)) for i in range(n)]
    cells = [(int(i % groups), int(i), f"f{j}", float(x[i, j])) for i in range(n) for j in range(k) if not np.isnan(x[i, j])]
    return spark.createDataFrame(cells, "g int, who long, f string, v double").repartition(5), spark.createDataFrame(people, "g int, who long, y double, fold int").repartition(3), x, y


def pivoted(cells, people):
    return people.join(cells.groupBy("g", "who").pivot("f").agg(F.first("v")), ["g", "who"], "left")


@pytest.mark.parametrize("side", [512, 3])
def test_equal_to_ridge_on_columns(spark, monkeypatch, side):
    monkeypatch.setattr(kernel, "SIDE_BY_SIDE", side)
    cells, people, _, _ = long_rows(spark, 60, 8)
    names = [f"f{j}" for j in range(8)]
    flat = pivoted(cells, people)
    got = {r["who"]: (r["true"], r["pred"]) for r in kernel.ridge(cells, people, "who", "f", "v", "y", ["g"], alphas=ALPHAS).collect()}
    want = {r["who"]: (r["true"], r["pred"]) for r in gram.predicted(flat, flat, "who", "y", names, ["g"], alphas=ALPHAS, left_out=True).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    got = {r["who"]: r["pred"] for r in kernel.ridge(cells, people, "who", "f", "v", "y", ["g"], "fold", ALPHAS).collect()}
    want = {r["who"]: r["pred"] for r in gram.predicted(flat, flat, "who", "y", names, ["g"], ["fold"], ALPHAS).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_more_columns_than_people(spark):
    cells, people, x, y = long_rows(spark, 24, 150, gaps=0.1, groups=1)
    got = {r["who"]: r["pred"] for r in kernel.ridge(cells, people, "who", "f", "v", "y", ["g"], "fold", ALPHAS).collect()}
    fold = np.arange(24) % 3
    for f in range(3):
        train = fold != f
        mean, sd = models._scale(x, train)
        z = np.nan_to_num((x - mean) / sd)

        def fit(rows, alpha, z=z):
            a = z[rows] - z[rows].mean(axis=0)
            w = a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(len(rows)), y[rows] - y[rows].mean())
            return lambda v: y[rows].mean() + (v - z[rows].mean(axis=0)) @ w

        at = np.flatnonzero(train)
        alpha = min(ALPHAS, key=lambda a: sum((fit(np.delete(at, i), a)(z[[r]])[0] - y[r]) ** 2 for i, r in enumerate(at)))
        assert np.allclose([got[i] for i in np.flatnonzero(fold == f)], fit(at, alpha)(z[fold == f]))


def test_people_without_cells_targets_or_company(spark):
    cells, people, _, _ = long_rows(spark, 20, 4, groups=1)
    more = spark.createDataFrame([(0, 100, 1.5, 0), (0, 101, None, 1), (7, 200, 2.0, 0), (None, 300, 1.0, 0)], people.schema)
    odd = spark.createDataFrame([(0, 101, "f0", 1.0), (0, 999, "f0", 5.0), (0, 1, "f1", float("nan")), (0, 2, None, 3.0), (0, 101, "f0", 3.0), (0, 3, "f9", float("inf"))], cells.schema)
    everyone = people.unionByName(more)
    got = {r["who"]: r for r in kernel.ridge(cells.unionByName(odd), everyone, "who", "f", "v", "y", ["g"], alphas=ALPHAS).collect()}
    assert got.keys() == {*range(20), 100, 101, 200, 300}
    assert got[101]["true"] is None and got[101]["pred"] is not None and got[200]["pred"] is None
    others = [r[0] for r in people.select("y").collect()]
    assert np.isclose(got[100]["pred"], np.mean(others))  # no cell: the mean of the others
    assert kernel.ridge(cells.limit(0), everyone, "who", "f", "v", "y", ["g"]).count() == 24
    assert kernel.ridge(cells, everyone.limit(0), "who", "f", "v", "y", ["g"]).count() == 0


@pytest.mark.parametrize("whole", [1024, 0])
def test_people_meet_only_along_shared_features(spark, monkeypatch, whole):
    rng = np.random.default_rng(8)
    people = [(int(i % 2), i, float(rng.normal()), i // 2 % 3) for i in range(80)]
    cells = {(i, f"f{j}") for j in range(60) for i in rng.choice(80, 3, replace=False).tolist()} | {(i, f"own{i}") for i in range(80)}
    held = spark.createDataFrame([(i % 2, i, f, float(rng.normal())) for i, f in sorted(cells)], "g int, who long, f string, v double")
    listed = spark.createDataFrame(people, "g int, who long, y double, fold int")
    names = sorted({f for _, f in cells})
    flat = pivoted(held, listed)
    monkeypatch.setattr(kernel, "BIN_PEOPLE", 6)
    monkeypatch.setattr(kernel, "WHOLE", whole)
    seen, real = [], kernel.summed

    def spy(parts, keys):
        seen.append(parts.agg(F.max(F.length("payload"))).first()[0])
        return real(parts, keys)

    monkeypatch.setattr(kernel, "summed", spy)
    for fold in (None, "fold"):
        got = {r["who"]: r["pred"] for r in kernel.ridge(held, listed, "who", "f", "v", "y", ["g"], fold, ALPHAS).collect()}
        want = {r["who"]: r["pred"] for r in gram.predicted(flat, flat, "who", "y", names, ["g"], [fold] if fold else (), ALPHAS, left_out=not fold).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert max(seen) < 8 * 40 * 40  # no matrix of all the group's people
