"""Prediction schemes, fold-safe corrections and small operators against loops and hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea import sources
from fovea.functions import scalars
from fovea.operators import budgets, debias, distances, features, filters, joins, models, reliability, schemes, scoring, splits, stats
from fovea.streaming import running_transitions, sessions


def people(n=60, seed=3, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = x @ [1.0, 0.3, 2.0] + rng.normal(size=n)
    rows = []
    for k in range(n):
        cells = [None if gaps and rng.random() < 0.1 else float(v) for v in x[k]]
        rows.append((k, f"L{k % 4}", k % 3, float(y[k]), *cells, float((k % 4) / 4 + 0.1 * rng.normal())))
    return rows


COLUMNS = "who long, L1 string, fold int, y double, a double, b double, c double, distance double"
X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(people(), COLUMNS).repartition(3)


# -- dependent correlations: degenerate cases have no value --------------------------------------------------------------


@pytest.mark.parametrize("test", [stats.steiger_z, stats.meng_z])
def test_degenerate_correlations_have_no_test(spark, test):
    cases = [(0.5, 0.4, 0.3, n, False) for n in (0, 1, 3)]
    for bad in (math.nan, math.inf, -math.inf, 1.0, -1.0, 1.5, None):
        cases += [(bad, 0.4, 0.3, 50, False), (0.5, bad, 0.3, 50, False), (0.5, 0.4, bad, 50, False)]
    meng = test is stats.meng_z  # the other's variance is not positive at 0.999
    cases += [(0.6, 0.4, 0.5, 4, True), (0.5, 0.4, 0.999, 50, meng), (0.6, 0.4, 0.5, 100, True)]
    df = spark.createDataFrame(cases, "a double, b double, ab double, n int, fine boolean")
    got = df.select("fine", test(F.col("a"), F.col("b"), F.col("ab"), F.col("n")).alias("z")).collect()
    assert all((r["z"] is not None and math.isfinite(r["z"])) == r["fine"] for r in got)


def test_identical_and_perfect_models_do_not_stop_a_sweep(spark):
    df = spark.createDataFrame([("same", float(k), float(k % 5), float(k % 5)) for k in range(9)] + [("perfect", float(k), float(k), float(k % 4)) for k in range(9)] + [("fine", float(k % 7), float(k), float(k % 4)) for k in range(9)], "g string, y double, x1 double, x2 double")
    got = {r["g"]: r for r in stats.compared(df, ["g"], "y", "x1", "x2").collect()}
    assert got["same"]["steiger_z"] is None and got["same"]["meng_p"] is None and got["perfect"]["meng_z"] is None
    assert got["fine"]["steiger_z"] is not None


# -- least squares and ridge by fold -------------------------------------------------------------------------------------


@pytest.mark.parametrize("model", ["ols", "ridge"])
def test_fits_from_sums_equal_fits_on_rows(rows, model):
    got = {r["who"]: r["pred"] for r in schemes.predicted_by_fold(rows, "who", "y", X, "L1", model=model).collect()}
    held = splits.fold_roles(rows.select("who", F.col("L1").alias("fold")), "who").join(rows, "who")
    want = {r["who"]: r["pred"] for r in models.cross_validated(held, "who", "y", X, model, ["segment"], top=None).collect()}
    assert len(got) == 60 and all(np.isclose(got[k], want[k], rtol=1e-6) for k in want)


def test_items_outside_item_and_fold(spark):
    data = [(k, i, float((k * 7 + i * 3) % 11 + 0.1 * k), float(k + i), k % 3) for k in range(12) for i in range(3)]
    df = spark.createDataFrame(data, "who long, item long, x double, y double, fold int")
    got = {(r["item"], r["who"]): r["pred"] for r in schemes.per_item(df, "who", "y", ["x"], "item", "UNSEEN").collect()}
    for k, i, x, _, f in data:
        rest = [(a, b) for _, j, a, b, g in data if j != i and g != f]
        slope, base = np.polyfit([a for a, _ in rest], [b for _, b in rest], 1)
        assert np.isclose(got[(i, k)], base + slope * x)
    seen = {(r["item"], r["who"]): r["pred"] for r in schemes.per_item(df, "who", "y", ["x"], "item", "SEEN").collect()}
    rest = [(a, b) for w, j, a, b, _ in data if j == 1 and w != 5]
    slope, base = np.polyfit([a for a, _ in rest], [b for _, b in rest], 1)
    assert np.isclose(seen[(1, 5)], base + slope * next(x for k, i, x, _, _ in data if (k, i) == (5, 1)))


def test_windows_reuse_the_first_windows_folds(spark):
    data = [(k, w, float(k % 5 + w), float(k), f"L{k % 2}") for k in range(20) for w in (1, 2)]
    df = spark.createDataFrame(data, "who long, win long, x double, y double, L1 string")
    got = schemes.moving_windows(df, "who", "y", ["x"], "win", "L1", k=4, model="ols").collect()
    assert len(got) == 40 and len({(r["who"], r["fold"]) for r in got}) == 20
    full = spark.createDataFrame([(k, float(k % 5), float(k)) for k in range(20)], "who long, x double, y double")
    on_full = schemes.cross_validation("moving", df, "who", "y", ["x"], "L1", "win", full, True, 4, "ols").collect()
    assert len(on_full) == 40 and all(r["pred"] is not None for r in on_full)
    with pytest.raises(Exception, match="not in the first window"):
        schemes.moving_windows(df.unionByName(spark.createDataFrame([(99, 2, 1.0, 1.0, "L0")], df.schema)), "who", "y", ["x"], "win", "L1", k=4, model="ols").collect()


def one_ridge(x, y, z, alphas=models.ALPHAS):
    """Ridge on the rows x, y by decomposition of the rows themselves, predicting z."""
    mean, sd = models._scale(x, np.ones(len(x), bool))
    fill = lambda v: np.nan_to_num((v - mean) / sd, posinf=0, neginf=0)
    _, w, b = models._ridge_path(fill(x), y, alphas)
    return fill(z) @ w + b


def test_nested_and_direct_ridge_equal_loops(spark):
    data = people(24, 5, gaps=False)
    df = spark.createDataFrame(data, COLUMNS)
    got = {r["who"]: r["pred"] for r in schemes.ridge_leave_one_out("nested", df, "who", "y", X, ["L1"], "fold").collect()}
    x, y = np.array([r[4:7] for r in data]), np.array([r[3] for r in data])
    for k in (0, 5, 11):
        rest = [i for i in range(24) if data[i][1] == data[k][1] and i != k]
        assert np.isclose(got[k], one_ridge(x[rest], y[rest], x[[k]])[0])
    roles = df.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))
    direct = {r["who"]: r["pred"] for r in schemes.direct_ridge(roles.withColumn("s", F.lit(1)), "who", "y", X, ["s"]).collect()}
    train = [i for i in range(24) if data[i][2] != 0]
    assert set(direct) == {i for i in range(24) if data[i][2] == 0}
    assert np.isclose(direct[0], one_ridge(x[train], y[train], x[[0]])[0])
    auto = schemes.ridge_leave_one_out("auto", df, "who", "y", X, ["L1"], "fold").collect()
    assert all(np.isclose(r["pred"], got[r["who"]]) for r in auto) and len(auto) == len(got)


def test_inner_folds_and_pooled_score():
    strata = np.array(["a"] * 10 + ["b"] * 10)
    for how, parts in (("holdout", 1), ("kfold", 5)):
        found = schemes.inner_folds(strata, how)
        assert len(found) == parts and all(len(h) == 4 and set(h).isdisjoint(t) and len(h) + len(t) == 20 for t, h in found)
        assert all((strata[h] == "a").sum() == 2 for _, h in found)
    assert len(schemes.inner_folds(np.array(["a", "b", "c"]), "kfold")) == 3
    assert schemes.pooled_score(np.array([1.0, 2, 3]), np.array([2.0, 4, 6])) == pytest.approx(1)
    assert schemes.pooled_score(np.array([1.0]), np.array([1.0])) == schemes.pooled_score(np.array([1.0, 2]), np.array([3.0, 3])) == -1


def test_search_takes_the_best_setting_and_never_scores_natives(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    data = [(k, "x" if k % 2 else "z", "test" if k < 16 else "train", float(5 * x[k] + 0.1 * rng.normal()), float(x[k]), True) for k in range(80)]
    natives = spark.createDataFrame([(100 + k, "en", 900.0, float(k)) for k in range(5)], "who long, L1 string, y double, a double")
    df = spark.createDataFrame(data, "who long, L1 string, role string, y double, a double, second boolean").withColumn("segment", F.lit(0))
    grid = [{"alpha": 1e6}, {"alpha": 1e-3}]
    got = schemes.tuned(df, "who", "y", ["a"], "ridge", grid, ["segment"], "L1", inner="kfold").collect()
    assert len(got) == 16 and all(abs(r["pred"] - r["true"]) < 1 for r in got)
    both = schemes.augmented(df.drop("second"), natives, 1.0)
    assert both.where("not second").count() == 5 and schemes.augmented(df.drop("second"), natives, 0.0).count() == 80
    assert {r["who"] for r in schemes.tuned(both, "who", "y", ["a"], "ridge", grid, ["segment"], "L1", use="second").collect()} == set(range(16))
    few = schemes.tuned(df.where("who < 19"), "who", "y", ["a"], "ridge", grid, ["segment"], "L1").collect()
    assert {r["config"] for r in few} == {-1}


def test_tree_settings_are_searched(rows):
    train, test = rows.where("who % 5 > 0"), rows.where("who % 5 = 0")
    out = schemes.tuned_trees(train, test, "who", "y", X, "L1", grid=[{"depth": 1, "least": 20}, {"depth": 4, "least": 1}]).collect()
    assert len(out) == 12 and len({r["pred"] for r in out}) > 2
    assert all(len(g) <= 10 for g in schemes.GRIDS.values())


# -- corrections ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["fixed", "random"])
def test_effects_by_fold_equal_refitting(rows, how):
    got = {r["who"]: r["effect"] for r in debias.effects_by_fold(rows, "y", "b", "fold", how=how).where("b is not null").collect()}
    df = rows.where("b is not null")
    got = {r["who"]: r["effect"] for r in debias.effects_by_fold(df, "y", "b", "fold", how=how).collect()}
    for f in range(3):
        want = {r["L1"]: r["effect"] for r in debias.language_effects(df.where(F.col("fold") != f), "y", "b", how=how).collect()}
        for r in df.where(F.col("fold") == f).select("who", "L1").collect():
            assert np.isclose(got[r["who"]], want[r["L1"]], atol=1e-9)


def test_interaction_by_fold_equals_least_squares(rows):
    df = rows.where("c is not null")
    data = df.select("who", "fold", "y", "c", "distance").collect()
    got = {r["fold"]: r["alpha"] for r in debias.interaction_by_fold(df, "y", "c", "fold").collect()}
    for f in range(3):
        rest = [r for r in data if r["fold"] != f]
        t, d, y = (np.array([r[k] for r in rest]) for k in ("c", "distance", "y"))
        t, d = t - t.mean(), d - d.mean()
        assert np.isclose(got[f], np.linalg.lstsq(np.column_stack([np.ones(len(t)), t, d, t * d]), y, rcond=None)[0][2], rtol=1e-6)


def test_corrections_that_lack_something_are_left_out(rows):
    df = rows.where("b is not null")
    list_ = [debias.Correction("mixed", "fixed", "fold"), debias.Correction("inter", "interaction", "L1", target="c"), debias.Correction("no", "two_step", "L1", skip_for=frozenset(["S"])), debias.Correction("gone", "two_step", "nowhere")]
    out = debias.all_corrections(df.where("c is not null"), list_, "who", "y", "b", "S")
    assert {r["variant"] for r in out.select("variant").distinct().collect()} == {"raw", "mixed", "inter"}
    assert debias.apply_correction(df, list_[2], "y", "b", "S") is None


def test_slope_bootstrap(rows):
    r = debias.delta_r_bootstrap(rows.where("b is not null").withColumn("g", F.lit(1)), "y", "b", ["g"], draws=200, statistic="b").first()
    data = rows.where("b is not null").select("y", "b", "distance").collect()
    y, t, d = (np.array([x[k] for x in data]) for k in ("y", "b", "distance"))
    rest = y - np.polyval(np.polyfit(t, y, 1), t)
    assert np.isclose(r["b_raw"], np.polyfit(d, rest, 1)[0]) and np.isclose(r["delta_b"], r["b_debiased"] - r["b_raw"]) and 0 < r["p"] <= 1


def test_fold_scores_equal_refitting(spark):
    rng = np.random.default_rng(4)
    second = spark.createDataFrame([(k, f"f{j}", float(rng.normal() + j), k % 3) for k in range(15) for j in range(4)], "who long, feature string, value double, fold int")
    native = spark.createDataFrame([(100 + k, f"f{j}", float(rng.normal() + 2 * j)) for k in range(6) for j in range(4)], "who long, feature string, value double")
    got = {r["who"]: r["eye_score"] for r in scoring.fold_scores(second, native, "who", "fold").collect()}
    for f in range(3):
        want = scoring.prototype_scores(second.where(F.col("fold") == f), native, ["who"], fit=second.where(F.col("fold") != f)).collect()
        assert all(np.isclose(got[r["who"]], r["eye_score"]) for r in want)


def test_paired_scores_leave_people_out(spark):
    rng = np.random.default_rng(6)
    rows = lambda first, shift, n=30: [(first + k, k % 3, float(rng.normal() + shift), float(rng.normal())) for k in range(n)]
    make = lambda r: spark.createDataFrame(r, "who long, fold int, a double, b double").withColumn("g", F.lit("x"))
    native, fit, target = make(rows(100, 3)), make(rows(0, 0)), make(rows(0, 0.2))
    got = scoring.paired_scores(native, fit, target, "who", "fold", ["a", "b"], ["g"]).collect()
    assert len(got) == 30 and np.mean([r["eye_score"] for r in got]) < 0
    apart = scoring.paired_scores(native, fit, make(rows(500, 3)), "who", "fold", ["a", "b"], ["g"]).collect()
    assert np.mean([r["eye_score"] for r in apart]) > 0
    with pytest.raises(ValueError, match="no prototype"):
        scoring.require_prototype("logistic")
    assert scoring.require_prototype("cosine") == "cosine"


# -- budgets -------------------------------------------------------------------------------------------------------------


def test_column_budgets(spark):
    pairs = [(f"T_p{p}_{i}_{j}", f"p{p}", i, j) for p in (2, 10) for i in range(5) for j in range(i, min(5, i + 2))]
    df = spark.createDataFrame(pairs, "name string, paragraph string, low int, high int")
    kept = {r["name"] for r in budgets.in_reading_order(df, 6).collect()}
    assert kept == {"T_p2_0_0", "T_p2_0_1", "T_p2_1_1", "T_p2_1_2", "T_p2_2_2"}  # the word after needs two more of the one left
    inside = lambda lo, hi: {f"T_p2_{i}_{j}" for _, p, i, j in pairs if p == "p2" and lo <= i and j <= hi}
    for anchor, want in (("start", inside(0, 2)), ("end", inside(2, 4)), ("middle", inside(1, 3))):
        got = {r["name"] for r in budgets.in_windows(df, 5, anchor).collect() if r["paragraph"] == "p2"}
        assert got == want
    assert budgets.within_budget(df, 100, True).count() == len(pairs)
    assert budgets.within_budget(df, 10, True).count() == 10 and budgets.within_budget(df, 10, False).count() <= 10
    with pytest.raises(ValueError, match="exceed"):
        budgets.within_budget(df, 3, True, always=4)


# -- small operators -----------------------------------------------------------------------------------------------------


def test_small_filters(spark):
    halves = spark.createDataFrame([(1, "odd", 5), (1, "even", 4), (2, "odd", 9), (2, "even", 3), (3, "odd", 9)], "who long, half string, n_paragraphs int")
    assert {r["who"] for r in filters.enough_paragraphs(halves, "who", 4).collect()} == {1}
    sd = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", None)], "feature string, sd double")
    assert [r["feature"] for r in filters.varying(sd).collect()] == ["b"]
    paths = spark.createDataFrame([("v1",), ("v1/inner",), ("v10",)], "path string")
    assert {r["path"] for r in paths.where(filters.version_matches("path", "v1")).collect()} == {"v1", "v1/inner"}
    assert filters.common_columns(halves, halves.drop("half")) == ["who", "n_paragraphs"]
    assert filters.language_column(halves) is None and filters.language_column(halves.withColumn("L1", F.lit("x"))) == "L1"
    assert filters.feature_set_columns(["participant_id", "L1", "T_a", "T_b", "ff"], ["ff", "zz"], None) == (["participant_id", "L1", "ff"], ["zz"])
    assert filters.feature_set_columns(["participant_id", "T_a", "T_b", "ff"], [], "T_") == (["participant_id", "T_a", "T_b"], [])
    assert filters.without_metadata(halves, ["half", "none"]).columns == ["who", "n_paragraphs"]
    sets = {"small": {"A": ["x"]}}
    assert filters.target_columns(sets, "A", "small") == ["x"] and filters.target_columns(sets, "B", "small") == [] and filters.target_columns(sets, "A", "?", ["y"]) == ["y"]
    with pytest.raises(ValueError, match="unknown target set"):
        filters.target_columns(sets, "A", "large")


def test_small_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "z")], "k long, v string")
    assert [tuple(r) for r in joins.with_suffix(a, b, ["k"]).collect()] == [(1, "x", "z")]
    scores = spark.createDataFrame([(1, "s", 1.0), (1, "t", 2.0), (2, "s", 3.0)], "who long, name string, value double")
    assert [tuple(r) for r in joins.wide_scores(scores, "who", "name", "value", ["s", "t"]).collect()] == [(1, 1.0, 2.0)]
    both = joins.tagged_union({"one": a, "two": b})
    assert sorted(tuple(r) for r in both.collect()) == [(1, "x", "one"), (1, "z", "two"), (2, "y", "one")]
    inside, outside = joins.by_membership(a, b, "k")
    assert [r["k"] for r in inside.collect()] == [1] and [r["k"] for r in outside.collect()] == [2]


def test_small_features_and_models(spark):
    df = spark.createDataFrame([(1, "de", 2.0), (1, "de", 4.0), (2, "it", 1.0)], "who long, L1 string, v double")
    assert sorted(tuple(r) for r in features.mean_over(df, ["who"], "v", ["L1"]).collect()) == [(1, 3.0, "de"), (2, 1.0, "it")]
    t = spark.createDataFrame([(True, -1.0), (True, 60.0), (True, 80.0), (False, -1.0)], "native boolean, y double")
    assert sorted(r["y"] for r in models.impute_native_targets(t, "y", "native", 100.0).collect()) == [-1.0, 60.0, 70.0, 80.0]
    assert sorted(r["y"] for r in models.impute_native_targets(t.where("y < 0"), "y", "native", 100.0).collect()) == [-1.0, 100.0]
    preds = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 5.0)], "who long, pred double, true double")
    assert [tuple(r) for r in models.combined_segments(preds, "who").collect()] == [(1, 3.0, 5.0)]
    r2 = spark.createDataFrame([(0.5, 11)], "r2 double, n long").select(stats.adjusted_r2("r2", "n", 2)).first()[0]
    assert r2 == pytest.approx(1 - 0.5 * 10 / 8)


def test_small_debias(spark):
    scores = spark.createDataFrame([(1, "de", 0.5, 60.0), (2, "it", 0.4, -1.0), (3, "xx", 0.3, 50.0)], "who long, L1 string, s double, y double")
    dist = spark.createDataFrame([("de", 0.2), ("it", 0.5)], "L1 string, distance double")
    assert [r["who"] for r in debias.prepared(scores, dist, "y").collect()] == [1]
    line = spark.createDataFrame([(float(k), 2.0 * k + 1 + (k % 2)) for k in range(6)], "x double, y double")
    assert sum(r["residual"] for r in debias.residuals(line, "y", "x").collect()) == pytest.approx(0)
    full = scores.join(dist, "L1")
    assert sorted(tuple(r) for r in debias.language_summary(full, "s").collect()) == [("de", 1, 0.5, 0.2), ("it", 1, 0.4, 0.5)]
    want = spark.createDataFrame([("a",), ("b",)], "variant string")
    assert [r["variant"] for r in debias.missing_variants(want.where("variant = 'a'"), want, ["variant"]).collect()] == ["b"]


def test_small_splits(spark):
    df = spark.createDataFrame([(k, "de" if k < 4 else "it", f"{k % 2}_Adv") for k in range(5)], "who long, L1 string, g string")
    assert {r["L1"] for r in splits.large_strata(df, "L1", 2).collect()} == {"de"}
    assert [r["fold"] for r in splits.leave_one_out(df, "who").orderBy("who").collect()] == list(range(5))
    for pool, train in (("ALL", {0: 5, 1: 5}), ("SEEN", {0: 3, 1: 2}), ("UNSEEN", {0: 2, 1: 3})):
        got = splits.pool_roles(df, "who", "g", pool).groupBy("segment", "role").count().collect()
        assert {int(r["segment"][0]): r["count"] for r in got if r["role"] == "train"} == train
        assert {int(r["segment"][0]): r["count"] for r in got if r["role"] == "test"} == {0: 3, 1: 2}


def test_small_scalars_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("12_Adv", "l3_77", 12, 1)], "g string, p string, b int, preview int")
    r = df.select(scalars.batch_of("g").alias("b"), scalars.combo_key("p", "b", "preview").alias("k"), scalars.pair_name("T", "g", "b", "preview").alias("n")).first()
    assert tuple(r) == ("12", "l3_12_1", "T_12_Adv_12_1")
    merged = spark.createDataFrame([("de", "f", 1.0), ("de", "f", 0.0), ("de", "g", -1.0), ("de", "g", 0.5)], "iso string, feature string, value double")
    assert {(r["feature"], r["value"]) for r in distances.merged_sources(merged).collect()} == {("f", 1.0), ("g", 0.5)}
    assert {(r["feature"], r["value"]) for r in distances.merged_sources(merged, "mean").collect()} == {("f", 0.5), ("g", 0.5)}
    names = spark.createDataFrame([("WP_COEFS_distance.csv",), ("WFC.csv",)], "name string")
    parts = sources.stem_and_variant("name")
    assert {(r[0], r[1]) for r in names.select(parts["feature_set"], parts["variant"]).collect()} == {("WP_COEFS", "distance"), ("WFC", "raw")}
    a, b = spark.createDataFrame([(1, 2.0)], "k long, x double"), spark.createDataFrame([(2, 3.0)], "k long, y double")
    assert sorted(tuple(r) for r in sources.aligned_union(a, b, "who", ("L1", "L2")).select("k", "x", "y", "who").collect()) == [(1, 2.0, 0.0, "L1"), (2, 0.0, 3.0, "L2")]
    long = spark.createDataFrame([("c", "f", 0.0), ("c", "g", 2.0), ("c", "g", 1.0), ("d", "f", None)], "corpus string, feature string, value double")
    assert [tuple(r) for r in sources.live_features(long, "corpus").collect()] == [("c", 1)]
    assert [r["k"] for r in sources.missing_items(a.unionByName(b.select("k", F.lit(0.0).alias("x"))), a, ["k"]).collect()] == [2]


def test_scores_in_a_result_tree(spark, tmp_path):
    root = str(tmp_path / "results")
    rows = spark.createDataFrame([("A", "All", "seen", "paragraph", "FF", k, i, float(k + i)) for k in range(3) for i in range(2)], "dataset string, preview string, pool string, level string, feature_set string, participant_id long, item long, score double")
    sources.write_by(rows, root, "dataset", "preview", "pool", "level", "feature_set")
    found = sources.item_scores(spark, root, rows.schema, dataset="A", preview="All", pool="seen", level="paragraph", feature_set="FF")
    assert found.count() == 6 and "PartitionFilters: [isnotnull(dataset" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in sources.original_scores(found, "participant_id", "score").collect()) == [(0, 0.5), (1, 1.5), (2, 2.5)]
    assert sources.item_scores(spark, str(tmp_path / "none"), rows.schema, dataset="A").count() == 0


def test_sessions_and_running_transitions(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:10:00", 2), (1, "2024-01-01 02:00:00", 1), (2, "2024-01-01 00:00:00", 3)], "who long, ts string, word int").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["n"] for r in sessions(events, "ts", "who").collect()) == [1, 1, 2]
    q = running_transitions(stream, "who", "ts", "word").writeStream.format("memory").queryName("trans").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("trans").collect()) == [(1, 1, 2, 1), (1, 2, 1, 1)]


def test_parts_and_pooled_reliability(spark):
    cells = spark.createDataFrame([(w, i, float((w * 3 + i * 5) % 7 + w), "g1" if w < 4 else "g2") for w in range(8) for i in range(1, 5)], "who long, item int, v double, g string")
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (9,)], "item int").select(reliability.part_of("item", {"a": (1, 2), "b": (3, 4)})).collect()] == ["a", "b", None]
    parts = {r["part"]: r for r in reliability.icc_by_part(cells, "who", "item", "v", {"a": (1, 2), "b": (3, 4)}).collect()}
    whole = reliability.icc(cells, "who", "item", "v").first()
    assert set(parts) == {"a", "b", "whole_test"} and parts["whole_test"]["icc3k"] == pytest.approx(whole["icc3k"])
    mean = reliability.icc_by_group(cells, "who", "item", "v", "g").first()
    each = reliability.icc(cells, "who", "item", "v", ["g"]).collect()
    assert mean["icc1"] == pytest.approx(np.mean([r["icc1"] for r in each])) and mean["people"] == 8 and mean["items"] == 4
