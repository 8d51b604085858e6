"""Hand-computed cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fovea import sources
from fovea.functions import report, special
from fovea.functions import scalars as S
from fovea.operators import debias, distances, features, filters, joins, models, reliability, scoring, splits, stats, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reading_speed_two_trials(spark):
    words = frame(spark, [("p", "a", 1000.0)] * 5 + [("p", "b", 2000.0)] * 5 + [("q", "a", 500.0)] * 3, "who string, trial string, rt double")
    got = {r["who"]: r["reading_speed"] for r in features.reading_speed(words, ["who"], "trial", "rt").collect()}
    assert got == {"p": pytest.approx(200.0), "q": pytest.approx(360.0)}


def test_transitions_count_only_on_text_and_fill_read_paragraphs(spark):
    rows = [("p1", 0, 0, 1), ("p1", 0, 1, 2), ("p1", 0, 2, 1), ("p1", 0, 1, 2), ("p1", 1, 0, 0), ("p2", 0, 0, 2), ("p2", 0, -1, 1), ("p2", 0, 0, None)]
    fix = frame(spark, rows, "who string, par int, cur int, nxt int")
    long = features.transitions(fix, ["who"], "par", "cur", "nxt")
    assert {(r["who"], r["par"], r["i"], r["j"]): r["value"] for r in long.collect()} == {("p1", 0, 0, 1): 1, ("p1", 0, 1, 2): 2, ("p1", 0, 2, 1): 1, ("p1", 1, 0, 0): 1, ("p2", 0, 0, 2): 1}
    full = {(r["who"], r["par"], r["i"], r["j"]): r["value"] for r in features.zero_filled(long, fix, ["who"], "par", ["i", "j"]).collect()}
    assert full[("p2", 0, 0, 1)] == 0 and full[("p1", 0, 0, 2)] == 0 and ("p2", 1, 0, 0) not in full and len(full) == 9


def test_dirty_values_and_sentinels(spark):
    df = frame(spark, [("7",), (".",), (None,), ("2.9",), ("NaN",)], "x string")
    got = df.select(S.dirty_int("x").alias("i"), S.dirty_float("x").alias("f")).collect()
    assert [r["i"] for r in got] == [7, 0, 0, 2, 0] and [r["f"] for r in got] == [7.0, None, None, 2.9, None]
    back = frame(spark, [(-1.0,), (3.0,), (None,), (float("nan"),)], "x double").select(S.sentinel_to_null("x").alias("n"), S.null_to_sentinel("x").alias("s")).collect()
    assert [r["n"] for r in back] == [None, 3.0, None, None] and [r["s"] for r in back] == [-1.0, 3.0, -1.0, -1.0]


def test_labels_stars_and_keys(spark):
    df = frame(spark, [("word-–", 0.0005, 0.6, 0.5, "p10"), ("a-b", 0.01, 0.5, 0.5, "p2"), ("x", 0.05, 0.4, 0.5, "p1"), (None, None, 1.0, 0.0, None)], "l string, p double, a double, b double, k string")
    got = df.select(S.strip_dashes("l").alias("l"), S.stars("p").alias("s"), S.signed_stars("p", "a", "b").alias("g"), S.natural_key("k").alias("k")).collect()
    assert [r["l"] for r in got] == ["word", "a-b", "x", None]
    assert [r["s"] for r in got] == ["***", "*", "ns", None] and [r["g"] for r in got] == [3, 0, 0, None]
    assert sorted([r["k"] for r in got if r["k"]])[0].startswith("p") and got[1]["k"] < got[0]["k"]
    name = frame(spark, [("transitions_3_12_15",), ("wfc_p1_4",)], "c string").select(S.parsed_pair("c").alias("s")).collect()
    assert name[0]["s"] == Row(paragraph="3", i=12, j=15) and name[1]["s"]["i"] == 4 and name[1]["s"]["j"] is None


def test_go_past_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(t, k, int(rng.integers(-1, 6)), float(rng.integers(50, 400))) for t in range(8) for k in range(int(rng.integers(1, 25)))]
    df = frame(spark, rows, "trial int, k int, word int, ms double")
    got = {(r["trial"], r["word"]): r["go_past"] for r in windows.go_past(df, ["trial"], ["k"], "word", "ms").collect()}
    want = {}
    for t in range(8):
        path = [(w, d) for tr, _, w, d in rows if tr == t and w >= 0]
        for k, (w, _) in enumerate(path):
            if (t, w) not in want:
                total = 0.0
                for v, d in path[k:]:
                    if v > w:
                        break
                    total += d
                want[(t, w)] = total
    assert got == pytest.approx(want)


def test_moving_windows_skip_empty_ones(spark):
    df = frame(spark, [("p", k) for k in (1, 2, 6)], "who string, par int")
    got = sorted((r["window_index"], r["par"]) for r in windows.id_windows(df, "who", "par", 2).collect())
    assert got == [(0, 1), (0, 2), (1, 2), (2, 6)]
    placed = sorted((r["window_index"], r["par"]) for r in windows.positional_windows(df, "who", ["par"], 2).collect())
    assert placed == [(0, 1), (0, 2), (1, 2), (1, 6)]


def test_filters(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 1), ("b", 3)], "who string, par int")
    assert {r["who"] for r in filters.full_readers(df, "who", ["par"], 3).collect()} == {"a"}
    assert filters.first_n(df, "who", ["par"], 2).count() == 5
    assert filters.trials(df, "first_id", "who", ["par"], 1).count() == 3
    with pytest.raises(ValueError):
        filters.trials(df, "odd", "who", ["par"], 1)
    wide = frame(spark, [(1, 1.0, None, None), (2, None, None, 2.0), (3, 1.0, float("nan"), 3.0)], "who int, x double, y double, z double")
    assert filters.filled_columns(wide, ["x", "y", "z"]) == ["x", "z"] and filters.filled_columns(wide, ["who", "x"], fully=True) == ["who"]
    assert filters.valid_targets(wide.withColumn("t", F.when(F.col("who") == 2, -1.0).otherwise(5.0)), "t", ["x", "y"]).count() == 2
    long = frame(spark, [("g", "f1", "a", 1.0), ("g", "f1", "b", 2.0), ("g", "f2", "a", 1.0), ("g", "f2", "b", None)], "grp string, feature string, who string, value double")
    assert {r["feature"] for r in filters.covered_features(long, "feature", "who", "value", ["grp"]).collect()} == {"f1"}
    assert {r["feature"] for r in filters.covered_features(long, "feature", "who", "value").collect()} == {"f1"}
    assert filters.valid_scheme("SEEN", "LOLO") and not filters.valid_scheme("UNSEEN", "POOL_ALL")
    with pytest.raises(ValueError):
        filters.require_seen(["content_group"], True, "ALL")


def test_joins(spark):
    left = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "k int, a string")
    right = frame(spark, [(1, 10), (2, 20), (2, 21), (4, 40)], "k int, v int")
    with pytest.raises(ValueError):
        joins.many_to_one(left, right, ["k"])
    once = joins.first_of_key(right, ["k"], ["v"])
    assert {r["k"]: r["v"] for r in joins.many_to_one(left, once, ["k"]).collect()} == {1: 10, 2: 20, 3: None}
    both, lost = joins.inner_with_lost(left, once, ["k"])
    assert both.count() == 2 and {(r["k"], r["side"]) for r in lost.collect()} == {(3, "left"), (4, "right")}
    ids = frame(spark, [("p", 1), ("p", 2), ("q", 1)], "who string, par int")
    fixed = joins.repair_ids(ids, frame(spark, [("p", 1, 2), ("p", 2, 3)], "who string, old_id int, new_id int"), ["who"], "par")
    assert sorted((r["who"], r["par"]) for r in fixed.collect()) == [("p", 2), ("p", 3), ("q", 1)]
    gaps = joins.shift_after_drop(frame(spark, [("p", k) for k in range(5)], "who string, ia bigint"), frame(spark, [("p", 1), ("p", 3)], "who string, ia bigint"), ["who"], "ia")
    assert sorted(r["ia"] for r in gaps.collect()) == [0, 1, 2]


def test_cosine_masks_and_single_feature(spark):
    z = frame(spark, [("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", None), ("q", "b", 1.0), ("r", "c", 1.0)], "who string, feature string, z double")
    proto = frame(spark, [("a", 2.0), ("b", -1.0)], "feature string, p double")
    got = {r["who"]: r["eye_score"] for r in scoring.cosine(z, proto, ["who"]).collect()}
    assert got["p"] == pytest.approx(0.0) and got["q"] == pytest.approx(-1.0) and "r" not in got
    one = {r["who"]: r["eye_score"] for r in scoring.cosine(z, proto.where("feature = 'a'"), ["who"]).collect()}
    assert one == {"p": 1.0}
    far = {r["who"]: r["eye_score"] for r in scoring.euclidean(z, proto, ["who"]).collect()}
    assert far["q"] == pytest.approx(-np.sqrt(4 + 4)) and far["p"] == pytest.approx(-np.sqrt(1 + 9))


def test_leave_one_out_equals_a_loop(spark):
    rng = np.random.default_rng(7)
    x, n = rng.normal(size=(20, 4)), rng.normal(size=(9, 4))
    long = lambda m: frame(spark, [(i, f"f{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "who int, feature string, value double")
    got = {r["who"]: r["eye_score"] for r in scoring.leave_one_out_cosine(long(x), long(n), "who").collect()}
    for i in range(20):
        rest = np.delete(x, i, axis=0)
        m, s = rest.mean(0), rest.std(0, ddof=1)
        z, p = (x[i] - m) / s, ((n - m) / s).mean(0)
        assert got[i] == pytest.approx(z @ p / np.sqrt((z @ z) * (p @ p)))


def test_debias_by_fold_equals_refitting(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"L{i % 4}", float(rng.normal()), float(rng.normal()), (i % 4) / 4) for i in range(40)]
    df = frame(spark, rows, "who int, L1 string, y double, t double, distance double")
    got = {r["who"]: (r["alpha"], r["debiased"]) for r in debias.debias_by_fold(df, "y", "t", "L1").collect()}
    mreg = {r["who"]: r["alpha"] for r in debias.debias_by_fold(df, "y", "t", "L1", how="distance_mreg").collect()}
    data = np.array([(y, t, d) for _, _, y, t, d in rows])
    for i, lang, y, _, d in rows:
        keep = np.array([r[1] != lang for r in rows])
        ty, tt, td = data[keep].T
        line = np.polyfit(tt, ty, 1)
        slope = np.polyfit(td, ty - np.polyval(line, tt), 1)[0]
        assert got[i] == pytest.approx((slope, y - slope * d))
        assert mreg[i] == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(keep.sum()), tt, td]), ty, rcond=None)[0][2])


def test_language_effects_sum_to_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(f"L{i % 5}", float(i % 5 + rng.normal() / 10), float(rng.normal())) for i in range(60)]
    df = frame(spark, rows, "L1 string, y double, t double")
    fixed = {r["L1"]: r["effect"] for r in debias.language_effects(df, "y", "t").collect()}
    shrunk = {r["L1"]: r["effect"] for r in debias.language_effects(df, "y", "t", how="random").collect()}
    assert sum(fixed.values()) == pytest.approx(0) and sum(shrunk.values()) == pytest.approx(0)
    assert fixed["L4"] - fixed["L0"] == pytest.approx(4, abs=0.3) and 0 < shrunk["L4"] <= fixed["L4"] + 0.3
    left = debias.without_effects(df.unionByName(frame(spark, [("new", 1.0, 1.0)], "L1 string, y double, t double")), spark.createDataFrame(list(fixed.items()), "L1 string, effect double"), "y")
    assert [r["debiased"] for r in left.where("L1 = 'new'").collect()] == [None]


def test_special_functions_against_known_values():
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05)
    assert special.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_dependent_correlations(spark):
    df = frame(spark, [(0.6, 0.4, 0.5, 100.0), (0.55, 0.45, 0.3, 64.0)], "a double, b double, ab double, n double")
    args = [F.col(c) for c in ("a", "b", "ab", "n")]
    got = df.select(stats.steiger_z(*args).alias("s"), stats.meng_z(*args).alias("m")).collect()
    assert [r["s"] for r in got] == pytest.approx([2.413132567334629, 0.8137363282206055])
    assert [r["m"] for r in got] == pytest.approx([2.390681112663852, 0.8124525456179834])


def test_correlations_guard_constants_and_small_groups(spark):
    df = frame(spark, [("c", 1.0, float(k)) for k in range(5)] + [("s", 1.0, 2.0), ("s", 2.0, 1.0)] + [("g", float(k), 2.0 * k + (k == 2)) for k in range(5)], "grp string, x double, y double")
    got = {r["grp"]: r for r in stats.correlations(df, "x", "y", ["grp"]).collect()}
    assert got["c"]["pearson_r"] is None and got["s"]["pearson_r"] is None
    assert got["g"]["pearson_r"] == pytest.approx(np.corrcoef(range(5), [0, 2, 5, 6, 8])[0, 1]) and 0 < got["g"]["pearson_p"] < 0.05
    ranked = {r["grp"]: r["spearman_r"] for r in stats.spearman(df, "x", "y", ["grp"]).collect()}
    assert ranked["g"] == pytest.approx(1.0)


def test_bootstrap_is_repeatable_and_sane(spark):
    rng = np.random.default_rng(0)
    rows = [("g", float(a), float(a + rng.normal()), float(rng.normal())) for a in rng.normal(size=60)]
    df = frame(spark, rows, "grp string, x double, t double, y double")
    one, two = (stats.bootstrap(df.repartition(k), ["grp"], "x", "t", draws=500).first() for k in (1, 3))
    assert one == two and one["low"] < one["r"] < one["high"]
    pair = stats.bootstrap_difference(df, ["grp"], "t", "x", "y", draws=500).first()
    assert pair["delta_r"] > 0 and 1 / 500 <= pair["p"] < 0.05


def test_logistic_coefficients_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g in range(60):
        n = int(rng.integers(1, 40))
        x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
        if g % 7 == 0:
            x[:, 2] = 3.0  # no second slope
        y = (x[:, 1] + rng.normal(size=n) * (g % 5 > 0) > 0).astype(float)
        who = None if g == 11 else g
        rows += [(who, "a", float(v), float(a), float(b)) for v, (_, a, b) in zip(y, x, strict=True)]
        w = features.logistic_fit(x, y) if 0 < y.sum() < n else None
        want[who] = None if w is None or features.separated(x, y, w) else w
    df = frame(spark, rows, "who int, h string, y double, a double, b double").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # groups run over the ends of batches
    try:
        got = {r["who"]: tuple(r)[2:] for r in features.logistic_coefficients(df, ["who", "h"], "y", ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and 10 < sum(w is not None for w in want.values()) < 60
    assert all(np.allclose(got[g], w) if w is not None else got[g] == (None, None, None) for g, w in want.items())
    assert features.logistic_coefficients(df, [], "y", ["a", "b"]).count() == 1


def test_first_component_equals_rounds_over_rows_in_few_jobs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 1)) * np.array([1.0, -2.0, 0.5, 1.5]) + rng.normal(size=(60, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7] = np.nan
    df = frame(spark, [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "who int, a double, b double, c double, d double")
    group = "first_component"
    spark.sparkContext.setJobGroup(group, group)
    got = {r["who"]: r["component"] for r in stats.first_component(df, "who", ["a", "b", "c", "d"], rounds=40, tolerance=0.0).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    z = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)
    seen, z = ~np.isnan(z), np.nan_to_num(z)
    w, noise = np.full(4, 0.5), 1.0
    for _ in range(40):
        below = seen @ (w * w) + noise
        f = z @ w / below
        square = f * f + noise / below
        new = z.T @ f / (seen.T @ square)
        noise = max(1e-9, ((z * z).sum(axis=0) - 2 * new * (z.T @ f) + new**2 * (seen.T @ square)).sum() / seen.sum())
        w = new
    w = -w if w.mean() < 0 else w
    assert np.allclose([got[i] for i in range(60)], z @ w / (seen @ (w * w) + noise)) and 0 < jobs < 10


def test_first_component_follows_the_factor(spark):
    rng = np.random.default_rng(9)
    f = rng.normal(size=80)
    rows = [(i, *(None if rng.random() < 0.1 else float(f[i] + rng.normal() / 4) for _ in range(3))) for i in range(80)]
    got = {r["who"]: r["component"] for r in stats.first_component(frame(spark, rows, "who int, a double, b double, c double"), "who", ["a", "b", "c"], rounds=30, tolerance=1e-4).collect()}
    assert np.corrcoef(f, [got[i] for i in range(80)])[0, 1] > 0.95


def test_reliability_by_hand(spark):
    x = np.array([[1, 2, 3], [2, 3, 5], [4, 4, 6], [3, 5, 5]], float)
    df = frame(spark, [(i, j, float(x[i, j])) for i in range(4) for j in range(3)], "who int, item int, value double")
    alpha = reliability.cronbach_alpha(df, "who", "item", "value").first()
    assert alpha["alpha"] == pytest.approx(1.5 * (1 - x.var(0, ddof=1).sum() / x.sum(1).var(ddof=1)))
    g = x.mean()
    msr, msc = 3 * ((x.mean(1) - g) ** 2).sum() / 3, 4 * ((x.mean(0) - g) ** 2).sum() / 2
    mse = ((x - x.mean(1, keepdims=True) - x.mean(0) + g) ** 2).sum() / 6
    icc = reliability.icc(df, "who", "item", "value").first()
    assert icc["icc3"] == pytest.approx((msr - mse) / (msr + 2 * mse)) and icc["icc3k"] == pytest.approx(alpha["alpha"])
    assert icc["icc2"] == pytest.approx((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / 4))
    reml = reliability.icc_crossed_reml(df.withColumn("g", F.lit(1)), "who", "item", "value", ["g"], rounds=5000).first()
    assert reml["var_error"] == pytest.approx(mse, rel=0.02) and reml["var_person"] == pytest.approx((msr - mse) / 3, rel=0.02)
    assert reliability.icc_all_readers(df.where("who != 3 or item != 0"), "who", "item", "value").first()["people"] == 4


def test_folds_spread_every_stratum(spark):
    people = frame(spark, [(i, "abc"[i % 3] if i < 20 else "d") for i in range(33)], "who int, s string")
    got = splits.stratified_folds(people, "who", "s", 4).collect()
    assert len(got) == 33
    for s in "abcd":
        sizes = np.bincount([r["fold"] for r in got if r["s"] == s], minlength=4)
        assert sizes.max() - sizes.min() <= 1
    sizes = np.bincount([r["fold"] for r in got], minlength=4)
    assert sizes.max() - sizes.min() <= 1
    halves = splits.half_splits(list(range(7)), splits=3)
    assert len(halves) == 21 and all(sorted(i for s, _, i in halves if s == k) == list(range(7)) for k in range(3))


def test_press_and_ridge_against_loops(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(15, 2)), rng.normal(size=15)
    df = frame(spark, [(i, *map(float, x[i]), float(y[i])) for i in range(15)], "who int, a double, b double, y double")
    got = {r["who"]: r["pred"] for r in models.press(df, "who", "y", ["a", "b"]).collect()}
    one = np.column_stack([np.ones(15), x])
    for i in range(15):
        w = np.linalg.lstsq(np.delete(one, i, 0), np.delete(y, i), rcond=None)[0]
        assert got[i] == pytest.approx(one[i] @ w)
    roles = splits.fold_roles(df.select("who", (F.col("who") % 3).alias("fold")), "who")
    out = models.cross_validated(roles.join(df, "who"), "who", "y", ["a", "b"], "ols", ["segment"], top=None).collect()
    assert len(out) == 15
    for r in out:
        keep = np.arange(15) % 3 != r["segment"]
        w = np.linalg.lstsq(one[keep], y[keep], rcond=None)[0]
        assert r["pred"] == pytest.approx(one[r["who"]] @ w)
    ridge = models.cross_validated(roles.join(df, "who"), "who", "y", ["a", "b"], "ridge", ["segment"]).collect()
    assert all(0 <= r["pred"] <= 100 for r in ridge)


def test_crossfit_ridge_with_one_alpha_is_exact_leave_one_out(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(16, 2)), rng.normal(size=16)
    df = frame(spark, [(i, "g", "ab"[i % 2], *map(float, x[i]), float(y[i])) for i in range(16)], "who int, grp string, s string, a double, b double, y double")
    got = models.crossfit_ridge(df, "who", "y", ["a", "b"], ["grp"], "s", alphas=[1e-9]).collect()
    one = np.column_stack([np.ones(16), x])
    for r in got:
        i = r["who"]
        w = np.linalg.lstsq(np.delete(one, i, 0), np.delete(y, i), rcond=None)[0]
        assert r["pred"] == pytest.approx(one[i] @ w, rel=1e-5, abs=1e-6)


def test_split_words_are_joined_and_fixations_follow(spark):
    joined, split = "another credit-card with the".split(), "another credit- card with the".split()
    rows = [("p", "1_0", k, w) for k, w in enumerate(joined)] + [("q", "1_0", k, w) for k, w in enumerate(split)] + [("r", "2_0", 0, "x")]
    words = frame(spark, rows, "who string, grp string, ia bigint, label string")
    fix = frame(spark, [("q", "1_0", k) for k in range(5)] + [("p", "1_0", 3), ("r", "2_0", 0)], "who string, grp string, ia bigint")
    from fovea.operators import realign

    fixed, moved = realign.align(words, fix, "who", ["grp"], "ia", "label")
    layout = lambda who: sorted((r["ia"], r["label"]) for r in fixed.where(F.col("who") == who).collect())
    assert layout("p") == layout("q") == list(enumerate(joined)) and layout("r") == [(0, "x")]
    assert sorted(r["ia"] for r in moved.where("who = 'q'").collect()) == [0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        realign.align(frame(spark, [("p", "g", 0, "x"), ("q", "g", 0, "y")], "who string, grp string, ia bigint, label string"), fix, "who", ["grp"], "ia", "label", passes=2)


def test_debias_gain_is_sane(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        d, t = (i % 6) / 6, float(rng.normal())
        rows.append(("g", f"L{i % 6}", t + 3 * d + float(rng.normal()) / 4, t, d))
    df = frame(spark, rows, "grp string, L1 string, y double, t double, distance double")
    r = debias.delta_r_bootstrap(df, "y", "t", ["grp"], draws=300).first()
    assert r["r_debiased"] > r["r_raw"] and r["low"] > 0 and r["p"] < 0.05


def test_fold_imputation_uses_other_folds(spark):
    df = frame(spark, [(1, 0, 1.0, None), (2, 0, None, None), (3, 1, 5.0, None), (4, 1, 7.0, None)], "who int, fold int, x double, y double")
    got = {r["who"]: (r["x"], r["y"]) for r in models.impute_by_fold(df, ["x", "y"], "fold").collect()}
    assert got == {1: (1.0, 0.0), 2: (6.0, 0.0), 3: (5.0, 0.0), 4: (7.0, 0.0)}


def test_distances(spark):
    t = frame(spark, [("en", "a", 0.0), ("de", "a", 1.0), ("fr", "a", 3.0), ("en", "b", 2.0), ("de", "b", 4.0)], "iso string, component string, distance double")
    assert {r["iso"]: r["distance"] for r in distances.distance(t, "a+b").collect()} == {"en": 1.0, "de": 2.5, "fr": 3.0}
    assert {r["iso"]: r["distance"] for r in distances.distance(t, "mm:a").collect()} == pytest.approx({"en": 0.0, "de": 1 / 3, "fr": 1.0})
    with pytest.raises(ValueError):
        distances.parse("zz:a")
    v = frame(spark, [("en", "x", 1.0), ("en", "y", 0.0), ("de", "x", 0.0), ("de", "y", 1.0)], "iso string, feature string, value double")
    assert {r["iso"]: r["distance"] for r in distances.angular(v, "en").collect()} == pytest.approx({"en": 0.0, "de": 1.0})
    named = distances.by_language(frame(spark, [("German",), ("Klingon",)], "L1 string"), t, {"German": "de"}, "a").collect()
    assert {r["L1"]: r["distance"] for r in named} == {"German": 1.0, "Klingon": None}


def test_upsert_and_fingerprint(spark, tmp_path):
    old = frame(spark, [("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3)], "d string, k int, r double")
    new = frame(spark, [("a", 1, 0.9)], "d string, k int, r double")
    assert sorted(map(tuple, sources.upsert(old, new, {"d": ["a"], "k": [1]}).collect())) == [("a", 1, 0.9), ("a", 2, 0.2), ("b", 1, 0.3)]
    assert sources.upsert(old, new).count() == 1
    assert sources.upsert_on_keys(old, new, ["d"]).count() == 2
    assert sources.fingerprint(old) == sources.fingerprint(old.repartition(3)) != sources.fingerprint(new)
    sources.write_by(old, str(tmp_path / "t"), "d")
    assert spark.read.parquet(str(tmp_path / "t")).where("d = 'a'").count() == 2
    assert sources.optional(spark, str(tmp_path / "none"), old.schema).count() == 0


def test_latex_marks_equal_prints(spark):
    df = frame(spark, [("b", "m1", 0.1231), ("b", "m2", 0.1229), ("b", "m_3", 0.05)], "block string, model string, r double")
    marked = report.best_marked(df, ["block"], {"r": "max"})
    text = report.latex(marked, {"model": "Model", "r": "r"}, ["model"], "A & B")
    assert text.count("\\textbf{0.123}") == 2 and "m\\_3 & 0.050" in text and "A \\& B" in text


def test_streaming_windows(spark, sf, tmp_path):
    from fovea import streaming

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_means(live, "ts", ["event_type"], "value", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert spark.table("w").count() == batch
