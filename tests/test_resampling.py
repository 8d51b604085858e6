"""Bootstraps from grouped sums, against weights and statistics computed row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import debias, resampling, stats


def plain_weight(key, draw, seed=42):
    """One weight in Python's own integers: a 64-bit hash of key and draw // 4, of which draw % 4 takes 16 bits."""
    wide = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & wide
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & wide
        return x ^ (x >> 31)

    bits = mixed((mixed((key + seed) & wide) + (draw // 4) * 0x9E3779B97F4A7C15) & wide) >> (16 * (draw % 4)) & 0xFFFF
    share, total, k = (bits + 0.5) / 65536, 0.0, 0
    while (total := total + math.exp(-1) / math.factorial(k)) < share:
        k += 1
    return k


def test_weights_are_poisson_numbers_hashed_from_key_and_draw():
    keys = np.array([0, 1, 12345, (1 << 64) - 1], np.uint64)
    got = resampling.weights(keys, 8, 30)
    assert got.tolist() == [[plain_weight(int(k), d) for d in range(8, 38)] for k in keys]
    many = resampling.weights(np.arange(2000, dtype=np.uint64), 0, 1000)
    assert abs(many.mean() - 1) < 0.005 and abs(many.var() - 1) < 0.01
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.15


def drawn(spark, n=40, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), "ab"[i % 2], f"L{i % 4}", float(x), float(x + rng.normal()), float(x / 2 + rng.normal()), (i % 4) / 4) for i, x in enumerate(rng.normal(1e4, 1, n))]
    df = spark.createDataFrame(rows, "who long, g string, L1 string, x double, y double, t double, distance double")
    keys = {r["who"]: r["k"] % (1 << 64) for r in df.select("who", F.xxhash64("who").alias("k")).collect()}
    return df, rows, keys


def weighted_r(w, a, b):
    a, b = a - np.average(a, weights=w), b - np.average(b, weights=w)
    return (w * a * b).sum() / math.sqrt((w * a * a).sum() * (w * b * b).sum())


@pytest.mark.parametrize("block,held", [(1000, 10**9), (8, 100)])
def test_intervals_equal_a_plain_bootstrap(spark, monkeypatch, block, held):
    monkeypatch.setattr(resampling, "DRAWS_A_BLOCK", block)
    monkeypatch.setattr(resampling, "HELD_BYTES", held)
    df, rows, keys = drawn(spark)
    got = {r["g"]: r for r in stats.bootstrap(df.repartition(5), ["g"], "x", "y", draws=60, who="who", mae=True).collect()}
    pair = {r["g"]: r for r in stats.bootstrap_difference(df.repartition(3), ["g"], "t", "x", "y", draws=60, who="who", mae=True).collect()}
    for g in "ab":
        own = [r for r in rows if r[1] == g]
        w = np.array([[plain_weight(keys[r[0]], d) for r in own] for d in range(60)], float)
        x, y, t = (np.array([r[k] for r in own]) for k in (3, 4, 5))
        r = np.array([weighted_r(v, x, y) for v in w])
        mae = np.array([np.average(np.abs(x - y), weights=v) for v in w])
        want = [20, np.corrcoef(x, y)[0, 1], r.mean(), r.std(ddof=1), *np.percentile(r, [2.5, 97.5]), np.abs(x - y).mean(), mae.mean(), mae.std(ddof=1), *np.percentile(mae, [2.5, 97.5])]
        assert np.allclose(list(got[g])[1:], want)
        delta = np.corrcoef(x, t)[0, 1] - np.corrcoef(y, t)[0, 1]
        d = np.array([weighted_r(v, x, t) - weighted_r(v, y, t) for v in w])
        off = np.abs(t - x).mean() - np.abs(t - y).mean()
        e = np.array([np.average(np.abs(t - x) - np.abs(t - y), weights=v) for v in w])
        want = [20, delta, *np.percentile(d, [2.5, 97.5]), max(1 / 60, (np.abs(d - delta) >= abs(delta)).mean()), off, *np.percentile(e, [2.5, 97.5]), max(1 / 60, (np.abs(e - off) >= abs(off)).mean())]
        assert np.allclose(list(pair[g])[1:], want)


@pytest.mark.parametrize("statistic,centre", [("r", True), ("r", False), ("b", True)])
def test_debiasing_gain_equals_a_plain_bootstrap(spark, statistic, centre):
    df, rows, keys = drawn(spark, n=48)
    got = debias.delta_r_bootstrap(df.repartition(4), "y", "t", ["g"], draws=40, who="who", statistic=statistic, centre=centre).collect()
    assert len(got) == 2
    df3 = df.withColumn("f", F.col("who") % 3)
    got = {r["g"]: r for r in debias.delta_r_bootstrap(df3, "y", "t", ["g"], lang="f", draws=40, who="who", statistic=statistic, centre=centre).collect()}

    def cov(w, a, b):
        return np.average(a * b, weights=w) - np.average(a, weights=w) * np.average(b, weights=w)

    def slope(w, y, t, d):
        return (cov(w, y, d) - cov(w, y, t) / cov(w, t, t) * cov(w, t, d)) / cov(w, d, d)

    for g in "ab":
        own = [r for r in rows if r[1] == g]
        y, t, d, f = np.array([r[4] for r in own]), np.array([r[5] for r in own]), np.array([r[6] for r in own]), np.array([r[0] % 3 for r in own])
        y = y - y.mean()

        def both(w, y=y, t=t, d=d, f=f):
            fixed = y.copy()
            for k in range(3):
                a, middle = slope(w[f != k], y[f != k], t[f != k], d[f != k]), np.average(d[f != k], weights=w[f != k]) if centre else 0
                fixed[f == k] -= a * (d[f == k] - middle)
            return (slope(w, y, t, d), slope(w, fixed, t, d)) if statistic == "b" else (weighted_r(w, y, t), weighted_r(w, fixed, t))

        raw, after = both(np.ones(len(own)))
        delta = np.array([np.subtract(*both(np.array([plain_weight(keys[r[0]], k) for r in own], float))[::-1]) for k in range(40)])
        gain = after - raw
        p = 2 * min((delta - gain >= gain).mean(), (delta - gain <= gain).mean())
        assert np.allclose(list(got[g])[1:], [24, raw, after, gain, *np.percentile(delta, [2.5, 97.5]), min(1.0, max(1 / 40, p))], rtol=1e-5)


def test_cells_too_small_or_constant(spark):
    rows = [("c", k, 1.0, float(k)) for k in range(5)] + [("s", k, float(k), float(k)) for k in range(2)] + [("n", k, None, 1.0) for k in range(5)] + [("f", k, float("nan"), 1.0) for k in range(5)] + [("e", 0, float(k % 3), float(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, who int, x double, y double")
    got = {r["g"]: r for r in stats.bootstrap(df, ["g"], "x", "y", draws=50, mae=True).collect()}
    assert set(got) == {"c", "s", "e"}
    assert got["c"]["r"] is None and got["c"]["mae"] == 1.4 and got["s"]["mae"] is None and got["s"]["n"] == 2
    assert got["e"]["boot_sd"] > 0  # equal rows are drawn apart
    assert stats.bootstrap(df.limit(0), ["g"], "x", "y", draws=10).count() == 0


def test_rows_of_one_partition_are_dealt_by_the_weights_they_need(spark, monkeypatch):
    monkeypatch.setattr(resampling, "WEIGHTS_A_TASK", 200)
    df, _, _ = drawn(spark)
    seen, real = [], resampling.summed

    def spy(parts, keys):
        seen.extend(r[0] for r in parts.groupBy(F.spark_partition_id()).count().collect())
        return real(parts, keys)

    monkeypatch.setattr(resampling, "summed", spy)
    got = stats.bootstrap(df.coalesce(1), ["g"], "x", "y", draws=60, who="who").collect()
    assert len(got) == 2 and len(seen) > 6  # 2400 weights, 200 a task
