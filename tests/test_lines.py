"""Nested leave-one-out on one column, against a system for each person."""

import numpy as np
import pytest

from fovea.operators import gram, lines, models, schemes


def one_column(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("large", 400), ("steep", 250), ("small", 30), ("flat", 150), ("two", 2), ("three", 3), ("gaps", 220)):
        x = rng.normal(5, 2, n)
        y = 0.1 * x + rng.normal(size=n)
        if g == "steep":
            x[:3] = (400.0, -90.0, 40.0)
        if g == "flat":
            x[:] = 3.0
            x[0] = 9.0  # without this reader the column is constant
        cells = [None if g == "gaps" and k % 5 == 0 else float(v) for k, v in enumerate(x)]
        rows += [(g, len(rows) + k, cells[k], float(y[k]), "a") for k in range(n)]
    return spark.createDataFrame([*rows, ("large", -1, 5.0, None, "a")], "L1 string, who long, x double, y double, s string").repartition(3)


@pytest.mark.parametrize("chunk", [5000, 60])
def test_equal_to_a_system_a_person_and_none_reaches_the_driver(spark, monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK_ROWS", chunk)
    df = one_column(spark)
    valid = df.dropna(subset=["y"])
    want = {r["who"]: r["pred"] for r in gram.predicted(valid, valid, "who", "y", ["x"], ["L1"], ["who"], models.ALPHAS).collect()}
    monkeypatch.setattr(gram, "shared", None)  # what sends systems through the driver
    got = {r["who"]: r["pred"] for r in schemes.ridge_leave_one_out("nested", df, "who", "y", ["x"], ["L1"], "s").collect()}
    assert got.keys() == want.keys() and sum(v is None for v in want.values()) == 2
    tied = {r["who"] for r in df.where("L1 = 'three'").collect()}  # two others: every penalty has the same error
    assert all((got[k] is None) == (want[k] is None) and (k in tied or want[k] is None or np.isclose(got[k], want[k], rtol=1e-9, atol=1e-9)) for k in want)


def test_without_groups_and_without_rows(spark):
    df = one_column(spark).where("L1 = 'large'")
    assert lines.left_out(df, "who", "y", "x", [], models.ALPHAS).count() == 400
    assert lines.left_out(df.limit(0), "who", "y", "x", ["L1"], models.ALPHAS).count() == 0
