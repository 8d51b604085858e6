"""Prediction schemes, fold-safe corrections, budgets and reliability by cell over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.functions import scalars
from fovea.operators import budgets, debias, features, filters, joins, kernel, reliability, schemes, scoring, splits, stats
from fovea.plans import roles
from fovea.plans.registry import least_squares, query, rounded, rounded_all
from fovea.plans.score_queries import _ACROSS, _SCORES, _WIDE, FEATURES, feature_rows, scores, wide_rows, with_distance
from fovea.plans.stat_queries import _CELLS, _WIDE2, _cells
from fovea.sources import table
from fovea.sources.shared import keep

W = roles.SQL
PARTS = {"first": (1, 3), "second": (4, 7)}
_GC = _CELLS + """, gc AS (SELECT cell.*, content_group AS g FROM cell JOIN meta ON who = participant_id)"""


def _grouped_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A row a reader and paragraph, with the reader's content group."""
    people = roles.readers(spark, sf).select(F.col("participant_id").alias("who"), "content_group")
    return _cells(spark, sf).join(people, "who")


def _parity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, i, h) for d, h, i in splits.parity_halves(range(1, 8))], "draw int, item int, half int")


# -- scores and corrections without leaks ------------------------------------------------------------------------------


@query(_WIDE + """, k AS (SELECT DISTINCT participant_id % 3 AS fold FROM lng WHERE NOT native),
st AS (SELECT fold, feature, avg(value) m, stddev_samp(value) s FROM k JOIN lng ON NOT native AND participant_id % 3 <> fold GROUP BY 1, 2 HAVING stddev_samp(value) > 1e-12),
pr AS (SELECT fold, st.feature, avg((value - m) / s) p FROM st JOIN lng ON lng.feature = st.feature AND native GROUP BY 1, 2),
z AS (SELECT participant_id, st.fold, st.feature, (value - m) / s z FROM lng JOIN st ON lng.feature = st.feature AND participant_id % 3 = st.fold WHERE NOT native)
SELECT participant_id, fold, round(sum(z * p) / sqrt(sum(z * z) * sum(p * p)), 6) + 0.0 AS eye_score FROM z JOIN pr USING (fold, feature) GROUP BY 1, 2""")
def fold_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Scores whose z statistics come from the readers of the other folds."""
    second, native = feature_rows(spark, sf)
    return rounded_all(scoring.fold_scores(second.withColumn("fold", F.col("participant_id") % 3), native, "participant_id", "fold"), 6, "eye_score")


_FOLDED = _SCORES + """, k AS (SELECT DISTINCT participant_id % 4 AS fold FROM ds)"""


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return with_distance(scores(spark, sf)).withColumn("fold", F.col("participant_id") % 4)


@query(_FOLDED + """, w AS (SELECT fold, L1, avg(eye_score) my, avg(score) mt, regr_sxx(eye_score, score) sxx, regr_sxy(eye_score, score) sxy FROM k JOIN ds ON participant_id % 4 <> fold GROUP BY 1, 2),
b AS (SELECT fold, sum(sxy) / sum(sxx) s FROM w GROUP BY 1), e AS (SELECT fold, L1, my - s * mt r FROM w JOIN b USING (fold)), c AS (SELECT fold, avg(r) a FROM e GROUP BY 1)
SELECT participant_id, ds.L1, round(eye_score - (r - a), 6) + 0.0 AS debiased FROM ds LEFT JOIN e ON e.fold = participant_id % 4 AND e.L1 = ds.L1 LEFT JOIN c ON c.fold = participant_id % 4""")
def fixed_l1_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = debias.effects_by_fold(_folded(spark, sf), "eye_score", "score", "fold")
    return rounded_all(out.select("participant_id", "L1", "debiased"), 6, "debiased")


@query()
def random_l1_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return debias.effects_by_fold(_folded(spark, sf), "eye_score", "score", "fold", how="random").select("participant_id", "L1", "debiased")


@query(_ACROSS + """, q AS (SELECT fold, eye_score AS y, score AS t, distance AS d, score * distance AS td FROM tr), """ + least_squares("q", "fold", "y", ["t", "d", "td"]) + """, c AS (SELECT fold, avg(t) AS mt, avg(d) AS md FROM q GROUP BY 1)
SELECT participant_id, L1, round(b_2 + b_3 * mt, 6) + 0.0 AS alpha, round(eye_score - (b_2 + b_3 * mt) * (distance - md), 6) + 0.0 AS debiased FROM ds JOIN ls ON L1 = ls.fold JOIN c ON c.fold = ls.fold""")
def interaction_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = debias.interaction_by_fold(_folded(spark, sf), "eye_score", "score", "L1", centre=True)
    return rounded_all(out.select("participant_id", "L1", "alpha", "debiased"), 6, "alpha", "debiased")


CORRECTIONS = (
    debias.Correction("across", "two_step", "L1"),
    debias.Correction("mreg", "distance_mreg", "L1"),
    debias.Correction("skipped", "two_step", "L1", skip_for=frozenset(["cosine"])),
    debias.Correction("without", "two_step", "no_such_column"),
)


@query(_ACROSS + """, a AS (SELECT fold, regr_slope(eye_score, score) b, regr_intercept(eye_score, score) c FROM tr GROUP BY 1),
r AS (SELECT fold, regr_slope(eye_score - c - b * score, distance) alpha FROM tr JOIN a USING (fold) GROUP BY 1),
q AS (SELECT fold, (covar_pop(eye_score, distance) * var_pop(score) - covar_pop(eye_score, score) * covar_pop(score, distance))
    / (var_pop(score) * var_pop(distance) - covar_pop(score, distance) * covar_pop(score, distance)) alpha FROM tr GROUP BY 1)
SELECT participant_id, 'raw' AS variant, round(eye_score, 6) + 0.0 AS score FROM ds
UNION ALL SELECT participant_id, 'across', round(eye_score - alpha * distance, 6) + 0.0 FROM ds JOIN r ON L1 = fold
UNION ALL SELECT participant_id, 'mreg', round(eye_score - alpha * distance, 6) + 0.0 FROM ds JOIN q ON L1 = fold""")
def all_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The raw score and each correction of a list that applies to this feature set."""
    return rounded_all(debias.all_corrections(with_distance(scores(spark, sf)), CORRECTIONS, "participant_id", "eye_score", "score", "cosine"), 6, "score")


@query(_ACROSS + """, a AS (SELECT fold, regr_slope(eye_score, score) b, regr_intercept(eye_score, score) c FROM tr GROUP BY 1),
r AS (SELECT fold, regr_slope(eye_score - c - b * score, distance) alpha FROM tr JOIN a USING (fold) GROUP BY 1),
d AS (SELECT ds.*, eye_score - alpha * distance AS debiased FROM ds JOIN r ON L1 = fold)
SELECT content_group, count(*) AS n, round(corr(eye_score, debiased), 6) + 0.0 AS r_raw_debiased, round(corr(debiased, score), 6) + 0.0 AS r_debiased, round(corr(debiased, score) - corr(eye_score, score), 6) + 0.0 AS delta_r FROM d GROUP BY 1""")
def correction_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = debias.debias_by_fold(with_distance(scores(spark, sf)), "eye_score", "score", "L1")
    out = stats.lookup(df, ["content_group"], {"r_raw_debiased": ("eye_score", "debiased"), "r_debiased": ("debiased", "score"), "r_raw": ("eye_score", "score")})
    return rounded_all(out.withColumn("delta_r", F.col("r_debiased") - F.col("r_raw")).drop("r_raw"), 6, "r_raw_debiased", "r_debiased", "delta_r")


@query(_SCORES + """, s AS (SELECT content_group, kind, eye_score, score, CASE kind WHEN 'a' THEN ((lang_no * 7) % 25) / 25.0 ELSE ((lang_no * 11) % 25) / 25.0 END AS distance FROM sc, (VALUES ('a'), ('b')) v(kind)),
f AS (SELECT content_group, kind, regr_slope(eye_score, score) b, regr_intercept(eye_score, score) c FROM s GROUP BY 1, 2),
r AS (SELECT s.*, eye_score - c - b * score AS residual FROM s JOIN f USING (content_group, kind))
SELECT content_group, kind, count(*) AS n, round(regr_slope(residual, distance), 6) + 0.0 AS alpha, round(corr(residual, distance), 6) + 0.0 AS r FROM r GROUP BY 1, 2""")
def bias_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every result cell against two kinds of distance, as one job over their key."""
    kinds = F.explode(F.create_map(F.lit("a"), (F.col("lang_no") * 7) % 25 / F.lit(25.0), F.lit("b"), (F.col("lang_no") * 11) % 25 / F.lit(25.0))).alias("kind", "distance")
    df = scores(spark, sf).select("content_group", "eye_score", "score", kinds)
    return rounded_all(debias.bias_summary(df, "eye_score", "score", ["content_group", "kind"]), 6, "alpha", "r")


@query()
def delta_b(spark: SparkSession, sf: str) -> DataFrame:
    return debias.delta_r_bootstrap(with_distance(scores(spark, sf)), "eye_score", "score", ["content_group"], statistic="b", who="participant_id")


@query()
def debias_gain_stratified(spark: SparkSession, sf: str) -> DataFrame:
    df = with_distance(scores(spark, sf))
    folds = splits.stratified_folds(df, "participant_id", "L1", 5).select("participant_id", "fold")
    return debias.delta_r_bootstrap(df.join(folds, "participant_id"), "eye_score", "score", ["content_group"], lang="fold", who="participant_id")


@query()
def paired_native_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the odd paragraphs, scored on the even ones, each reader out of their own fit."""
    w = roles.words(spark, sf, numbered=False).withColumn("even", F.col("paragraph") % 2 == 0)
    about = roles.readers(spark, sf).select("participant_id", "native", "content_group")
    wide = keep(features.metric_means(w, ["participant_id", "even"], {m: m for m in FEATURES}).join(about, "participant_id"))
    fold = F.pmod(F.xxhash64("participant_id"), F.lit(5)).alias("fold")
    part = lambda rule: wide.where(rule).select("participant_id", "content_group", fold, *FEATURES)
    return scoring.paired_scores(part("native and even"), part("not native and not even"), part("not native and even"), "participant_id", "fold", FEATURES, ["content_group"])


# -- prediction schemes ------------------------------------------------------------------------------------------------


@query(_WIDE2 + """, k AS (SELECT DISTINCT L1 AS fold FROM mr), f AS (SELECT fold, regr_slope(score, ff) b, regr_intercept(score, ff) a FROM k JOIN mr ON L1 <> fold GROUP BY 1)
SELECT L1, participant_id, score AS "true", round(a + b * ff, 3) + 0.0 AS pred FROM mr JOIN f ON L1 = fold""")
def line_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares for each language on all others, from sums less the own."""
    rows = wide_rows(spark, sf).where("not native")
    out = schemes.predicted_by_fold(rows, "participant_id", "score", ["ff"], "L1", model="ols")
    return out.select("L1", "participant_id", "true", rounded("pred", 3).alias("pred"))


_ITEMS = W + """, it AS (SELECT participant_id, paragraph, avg(ff) x, any_value(score) y, participant_id % 3 AS fold FROM words0 JOIN meta USING (participant_id) WHERE NOT native GROUP BY 1, 2)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """A row a reader and paragraph."""
    w = features.metric_means(roles.words(spark, sf, numbered=False), ["participant_id", "paragraph"], {"x": "ff"})
    return keep(w.join(roles.readers(spark, sf).where("not native"), "participant_id").select("participant_id", "paragraph", "x", F.col("score").alias("y"), (F.col("participant_id") % 3).alias("fold"), "L1"))


@query(_ITEMS + """, f AS (SELECT paragraph, k.fold, regr_slope(y, x) b, regr_intercept(y, x) a FROM (SELECT DISTINCT fold FROM it) k JOIN it ON it.fold <> k.fold GROUP BY 1, 2)
SELECT paragraph, participant_id, y AS "true", round(a + b * x, 3) + 0.0 AS pred FROM it JOIN f USING (paragraph, fold)""")
def items_independent(spark: SparkSession, sf: str) -> DataFrame:
    out = schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "INDEPENDENT")
    return out.select("paragraph", "participant_id", "true", rounded("pred", 3).alias("pred"))


@query(_ITEMS + """, t AS (SELECT paragraph, count(*) n, sum(x) x, sum(x * x) xx, sum(y) s, sum(x * y) xy FROM it GROUP BY 1),
l AS (SELECT paragraph, participant_id, it.y, it.x AS fx, n - 1 AS n, t.x - it.x AS x, xx - it.x * it.x AS xx, s - it.y AS s, xy - it.x * it.y AS xy FROM it JOIN t USING (paragraph))
SELECT paragraph, participant_id, y AS "true", round((s - (n * xy - x * s) / (n * xx - x * x) * x) / n + (n * xy - x * s) / (n * xx - x * x) * fx, 2) + 0.0 AS pred FROM l""")
def items_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Leave one participant out inside each item: exact, by the hat matrix of the item."""
    out = schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "SEEN")
    return out.select("paragraph", "participant_id", "true", rounded("pred", 2).alias("pred"))


@query(_ITEMS + """, c AS (SELECT DISTINCT paragraph, fold FROM it), f AS (SELECT c.paragraph, c.fold, regr_slope(y, x) b, regr_intercept(y, x) a FROM c JOIN it ON it.paragraph <> c.paragraph AND it.fold <> c.fold GROUP BY 1, 2)
SELECT paragraph, participant_id, y AS "true", round(a + b * x, 3) + 0.0 AS pred FROM it JOIN f USING (paragraph, fold)""")
def items_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Learned on other items of other people: all sums, less the item's, less the fold's, plus what is in both."""
    out = schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "UNSEEN")
    return out.select("paragraph", "participant_id", "true", rounded("pred", 3).alias("pred"))


def _cells_of_items(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: a row a reader, paragraph and part that they met there: the mean dwell."""
    w = roles.words(spark, sf, numbered=False).where("rr is not null")
    return w.groupBy("participant_id", "paragraph", "part_key").agg(F.avg("fp").alias("value"))


@query(W + """, it AS (SELECT DISTINCT participant_id, paragraph FROM words0 JOIN meta USING (participant_id) WHERE NOT native),
c AS (SELECT participant_id, paragraph, part_key, avg(fp) AS value FROM words0 WHERE rr IS NOT NULL GROUP BY 1, 2, 3)
SELECT participant_id, paragraph, part_key, round(value, 6) + 0.0 AS value FROM it LEFT JOIN c USING (participant_id, paragraph)""")
def per_text_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of a subset's readers with its text's cells as long rows; items without any stay."""
    out = joins.with_cells(_items(spark, sf).select("participant_id", "paragraph"), _cells_of_items(spark, sf), ["participant_id", "paragraph"])
    return out.select("participant_id", "paragraph", "part_key", rounded("value", 6).alias("value"))


@query()
def per_text_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Each item and language: its readers from all others by the text's cells, of which there are more than readers."""
    people = _items(spark, sf).select("paragraph", "L1", "participant_id", "y")
    cells = joins.with_cells(people.drop("y"), _cells_of_items(spark, sf), ["participant_id", "paragraph"])
    return kernel.ridge(cells, people, "participant_id", "part_key", "value", "y", ["paragraph", "L1"])


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    """A row a reader and paragraph as the window, of all readers of the first paragraph."""
    rows = _items(spark, sf)
    return keep(rows.join(rows.where("paragraph = 1").select("participant_id"), "participant_id", "left_semi"))


@query()
def moving_windows_cv(spark: SparkSession, sf: str) -> DataFrame:
    return schemes.cross_validation("moving", _windowed(spark, sf), "participant_id", "y", ["x"], "L1", window="paragraph", model="ols")


@query()
def moving_windows_on_full(spark: SparkSession, sf: str) -> DataFrame:
    full = wide_rows(spark, sf).where("not native").select("participant_id", F.col("ff").alias("x"), F.col("score").alias("y"), "L1")
    return schemes.cross_validation("moving", _windowed(spark, sf), "participant_id", "y", ["x"], "L1", window="paragraph", full=full, train_on_full=True, model="ols")


@query()
def nested_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return schemes.ridge_leave_one_out("auto", wide_rows(spark, sf).where("not native"), "participant_id", "score", FEATURES, ["L1"], "content_group")


@query()
def direct_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Each content group predicted from one fit on another group's readers."""
    rows = wide_rows(spark, sf).where("not native")
    group = F.pmod(F.crc32("content_group"), F.lit(2))
    return schemes.direct_ridge(rows.withColumns({"segment": F.lit(0), "role": F.when(group == 0, "test").otherwise("train")}), "participant_id", "score", FEATURES, ["segment"])


@query()
def tuned_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Five outer folds; alpha searched on five inner ones; natives of the outer training rows help to train."""
    rows = wide_rows(spark, sf)
    second = rows.where("not native")
    folds = splits.stratified_folds(second, "participant_id", "L1", 5).select("participant_id", "fold")
    held = splits.fold_roles(folds, "participant_id").join(second, "participant_id")
    both = schemes.augmented(held, rows.where("native"), 1.0)
    return schemes.tuned(both, "participant_id", "score", FEATURES, "ridge", [{"alpha": a} for a in (0.1, 10.0, 1000.0)], ["segment"], "L1", use="second")


@query(W + """, p AS (SELECT participant_id, paragraph, avg(ff) m FROM words0 GROUP BY 1, 2), f AS (SELECT participant_id, avg(ff) f FROM words0 GROUP BY 1)
SELECT content_group, paragraph, count(*) AS n, round(corr(m, score), 6) + 0.0 AS pearson_r, round(avg(abs(m - score)), 4) + 0.0 AS mae, round(avg(m - f), 6) + 0.0 AS bias
FROM p JOIN f USING (participant_id) JOIN meta USING (participant_id) WHERE NOT native GROUP BY 1, 2 HAVING count(*) >= 3""")
def window_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation, error and bias of every moving window."""
    full = wide_rows(spark, sf).where("not native").select("participant_id", F.col("ff").alias("f"), "content_group")
    df = _items(spark, sf).join(full, "participant_id")
    out = stats.window_curve(df, "x", "y", "paragraph", ["content_group"], full="f").where("n >= 3")
    return rounded_all(out.withColumn("mae", F.round("mae", 4) + F.lit(0.0)), 6, "pearson_r", "bias")


@query("""
WITH e AS (SELECT DISTINCT c_nationkey * 3 + c_custkey % 3 AS k, 'f' || (c_custkey % 3) AS fs, 'm' || (c_nationkey % 2) AS model FROM customer)
SELECT a.k AS a, b.k AS b, a.fs = 'f0' OR b.fs = 'f0' AS is_baseline, a.fs = b.fs AND (a.model = 'm0') <> (b.model = 'm0') AS is_ridge FROM e a JOIN e b ON a.k < b.k""")
def pair_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the result entries that a sweep compares: one for each nation and feature set."""
    c = table(spark, sf, "customer")
    e = c.select((F.col("c_nationkey") * 3 + F.col("c_custkey") % 3).alias("k"), F.concat(F.lit("f"), (F.col("c_custkey") % 3).cast("string")).alias("fs"), F.concat(F.lit("m"), (F.col("c_nationkey") % 2).cast("string")).alias("model")).distinct()
    a, b = (e.select(*[F.col(c).alias(f"{c}_{side}") for c in e.columns]) for side in "ab")
    pairs = a.join(F.broadcast(b), F.col("k_a") < F.col("k_b"))
    return stats.pair_kinds(pairs, "fs_a", "fs_b", "model_a", "model_b", "f0", "m0").select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "is_baseline", "is_ridge")


# -- column budgets ----------------------------------------------------------------------------------------------------

_NAMES = """
WITH n AS (SELECT p_partkey AS name, 'p' || (p_size % 12) AS paragraph, (p_partkey % 40)::INTEGER AS low, (p_partkey % 40 + p_partkey % 9)::INTEGER AS high FROM part)"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    low = F.col("p_partkey") % 40
    return p.select(F.col("p_partkey").alias("name"), F.concat(F.lit("p"), (F.col("p_size") % 12).cast("string")).alias("paragraph"), low.cast("int").alias("low"), (low + F.col("p_partkey") % 9).cast("int").alias("high"))


@query(_NAMES + """, u AS (SELECT paragraph, high, count(*) c FROM n GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER (ORDER BY substr(paragraph, 2)::INTEGER, high ROWS UNBOUNDED PRECEDING) t FROM u)
SELECT name, paragraph FROM n JOIN k USING (paragraph, high) WHERE t <= 80""")
def budget_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return budgets.in_reading_order(_names(spark, sf), 100, always=20).select("name", "paragraph")


@query(_NAMES + """, w AS (SELECT DISTINCT paragraph, unnest([low, high]) word FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY paragraph ORDER BY word) - 1 place, count(*) OVER (PARTITION BY paragraph) size FROM w),
s AS (SELECT n.*, greatest(a.size // 2 - a.place, b.place - a.size // 2) step FROM n JOIN q a ON a.paragraph = n.paragraph AND a.word = low JOIN q b ON b.paragraph = n.paragraph AND b.word = high),
c AS (SELECT *, count(*) OVER (PARTITION BY paragraph ORDER BY step) t FROM s)
SELECT name, paragraph FROM c WHERE t <= 5""")
def budget_windows(spark: SparkSession, sf: str) -> DataFrame:
    return budgets.in_windows(_names(spark, sf), 5).select("name", "paragraph")


# -- reliability by group, part and cell -------------------------------------------------------------------------------


@query(_GC + """, ki AS (SELECT g, count(DISTINCT item) k FROM gc GROUP BY 1), ok AS (SELECT g, who FROM gc JOIN ki USING (g) GROUP BY g, who, k HAVING count(*) = k), c AS (SELECT gc.* FROM gc JOIN ok USING (g, who)),
p AS (SELECT g, count(*) n, sum(s * s / k) a FROM (SELECT g, who, sum(value) s, count(*) k FROM c GROUP BY 1, 2) GROUP BY 1), i AS (SELECT g, count(*) k, sum(s * s / n) d FROM (SELECT g, item, sum(value) s, count(*) n FROM c GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT g, sum(value * value) q, sum(value) * sum(value) / count(*) z FROM c GROUP BY 1),
m AS (SELECT n, k, (a - z) / (n - 1) r, (d - z) / (k - 1) c, (q - a) / (n * (k - 1)) w, (q - a - d + z) / ((n - 1) * (k - 1)) e FROM p JOIN i USING (g) JOIN t USING (g) WHERE n > 1 AND k > 1)
SELECT sum(n)::BIGINT AS people, floor(avg(k))::BIGINT AS items, round(avg((r - w) / (r + (k - 1) * w)), 6) + 0.0 AS icc1, round(avg((r - e) / (r + (k - 1) * e + k * (c - e) / n)), 6) + 0.0 AS icc2, round(avg((r - e) / (r + (k - 1) * e)), 6) + 0.0 AS icc3,
  round(avg((r - w) / r), 6) + 0.0 AS icc1k, round(avg((r - e) / (r + (c - e) / n)), 6) + 0.0 AS icc2k, round(avg((r - e) / r), 6) + 0.0 AS icc3k FROM m HAVING count(*) > 0""")
def icc_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.icc_by_group(_grouped_cells(spark, sf), "who", "item", "ff", "content_group").where("people is not null"), 6, *reliability.COEFFICIENTS)


@query(_GC + """, d AS (SELECT who, item, value - avg(value) OVER (PARTITION BY g) y FROM gc), o AS (SELECT who, count(*) c, avg(y) m, var_pop(y) * count(*) q FROM d GROUP BY 1),
t AS (SELECT count(*) g, round(avg(c)) k, sum(c) n, sum(c * c) cc, sum(q) w, sum(c * m * m) - sum(c * m) * sum(c * m) / sum(c) b FROM o),
v AS (SELECT g, k, b / (g - 1) b, w / (n - g) w, (n - cc / n) / (g - 1) k0 FROM t), x AS (SELECT g, k, (b - w) / (b + (k0 - 1) * w) i FROM v)
SELECT g AS people, k::BIGINT AS items, round(i, 6) + 0.0 AS icc1, round(k * i / (1 + (k - 1) * i), 6) + 0.0 AS icc1k FROM x""")
def icc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.icc_pooled(_grouped_cells(spark, sf), "who", "item", "ff", "content_group"), 6, "icc1", "icc1k")


@query()
def icc_pooled_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The coefficients that no single analysis of variance gives over groups."""
    return reliability.icc_pooled_mixed(_grouped_cells(spark, sf), "who", "item", "ff", "content_group")


@query(_GC + """, i AS (SELECT g, item, var_samp(value) v FROM gc GROUP BY 1, 2), ii AS (SELECT g, count(*) k, sum(v) v FROM i GROUP BY 1), t AS (SELECT g, who, sum(value) t, avg(value) m FROM gc GROUP BY 1, 2),
tt AS (SELECT g, count(*) n, var_samp(t) v, stddev_samp(m) s FROM t GROUP BY 1), h AS (SELECT g, who, avg(value) FILTER (item % 2 = 0) x, avg(value) FILTER (item % 2 = 1) y FROM gc GROUP BY 1, 2),
r AS (SELECT g, corr(x, y) r FROM h WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1), a AS (SELECT g, k, n, k / (k - 1.0) * (1 - ii.v / tt.v) a, s, 2 * r / (1 + r) b FROM ii JOIN tt USING (g) JOIN r USING (g))
SELECT g AS content_group, k AS items, n AS people, round(a, 6) + 0.0 AS alpha, round(s * sqrt(greatest(0, 1 - a)), 6) + 0.0 AS alpha_sem, round(b, 6) + 0.0 AS split_half, round(s * sqrt(greatest(0, 1 - b)), 6) + 0.0 AS split_half_sem, round(s, 6) + 0.0 AS sd FROM a""")
def reliability_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha, split half and their standard errors for each result cell."""
    out = reliability.reliability_row(_grouped_cells(spark, sf), _parity(spark), "who", "item", "ff", ["content_group"])
    return rounded_all(out, 6, "alpha", "alpha_sem", "split_half", "split_half_sem", "sd")


_SPLITS = _GC + """, s AS (SELECT g, who, split, CASE split WHEN 0 THEN item % 2 ELSE (item > 3)::INTEGER END AS half, value FROM gc, (VALUES (0), (1)) v(split)),
h AS (SELECT g, split, who, avg(value) FILTER (half = 0) x, avg(value) FILTER (half = 1) y FROM s GROUP BY 1, 2, 3), r AS (SELECT g, split, corr(x, y) r FROM h WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)"""


@query(_SPLITS + """ SELECT g AS content_group, count(r) AS splits, round(avg(r), 6) + 0.0 AS r_mean, round(stddev_pop(r), 6) + 0.0 AS r_sd, round(avg(2 * r / (1 + r)), 6) + 0.0 AS reliability, round(stddev_pop(2 * r / (1 + r)), 6) + 0.0 AS reliability_sd FROM r GROUP BY 1
UNION ALL SELECT 'All', count(r), round(avg(r), 6) + 0.0, round(stddev_pop(r), 6) + 0.0, round(avg(2 * r / (1 + r)), 6) + 0.0, round(stddev_pop(2 * r / (1 + r)), 6) + 0.0 FROM r""")
def split_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores of two splits: by content group, and over all (group, split) values."""
    cells = _grouped_cells(spark, sf)
    half = F.when(F.col("split") == 0, F.col("item") % 2).otherwise((F.col("item") > 3).cast("int"))
    rows = cells.withColumn("split", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", half)
    by_split = reliability.split_correlations(rows, "who", "ff", "split", "half", ["content_group"])
    out = reliability.split_summary(by_split, ["content_group"]).unionByName(reliability.split_summary(by_split).withColumn("content_group", F.lit("All")))
    return rounded_all(out, 6, "r_mean", "r_sd", "reliability", "reliability_sd")


_PARTED = _GC + """, q AS (SELECT who, item, value, CASE WHEN item <= 3 THEN 'first' ELSE 'second' END AS part FROM gc)"""


@query(_PARTED + """, i AS (SELECT part, item, var_samp(value) v FROM q GROUP BY 1, 2), ii AS (SELECT part, count(*) k, sum(v) v FROM i GROUP BY 1), t AS (SELECT part, who, sum(value) t FROM q GROUP BY 1, 2), tt AS (SELECT part, count(*) n, var_samp(t) v FROM t GROUP BY 1),
h AS (SELECT part, who, avg(value) FILTER (item % 2 = 0) x, avg(value) FILTER (item % 2 = 1) y FROM q GROUP BY 1, 2), r AS (SELECT part, corr(x, y) r FROM h WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
a AS (SELECT k / (k - 1.0) * (1 - ii.v / tt.v) a, 2 * r / (1 + r) b, n FROM ii JOIN tt USING (part) JOIN r USING (part))
SELECT 'All' AS preview, max(n) AS people, count(*) AS parts, round(avg(a), 6) + 0.0 AS avg_part_alpha, round(avg(b), 6) + 0.0 AS avg_part_split_half FROM a""")
def reliability_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a test by item range, and their unweighted mean."""
    cells = _grouped_cells(spark, sf).withColumn("preview", F.lit("All"))
    rows = reliability.by_part(cells, _parity(spark), "who", "item", "ff", PARTS, ["preview"])
    whole = spark.createDataFrame([("All",)], "preview string")
    return rounded_all(reliability.over_parts(rows, whole, "preview"), 6, "avg_part_alpha", "avg_part_split_half")


@query(_PARTED + """, w AS (SELECT part, who, item, value FROM q UNION ALL SELECT 'whole_test', who, item, value FROM q), ki AS (SELECT part, count(DISTINCT item) k FROM w GROUP BY 1), ok AS (SELECT part, who FROM w JOIN ki USING (part) GROUP BY part, who, k HAVING count(*) = k),
c AS (SELECT w.* FROM w JOIN ok USING (part, who)), p AS (SELECT part, count(*) n, sum(s * s / k) a FROM (SELECT part, who, sum(value) s, count(*) k FROM c GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT part, count(*) k, sum(s * s / n) d FROM (SELECT part, item, sum(value) s, count(*) n FROM c GROUP BY 1, 2) GROUP BY 1), t AS (SELECT part, sum(value * value) q, sum(value) * sum(value) / count(*) z FROM c GROUP BY 1)
SELECT part, k AS items, n AS people, round(((a - z) / (n - 1) - (q - a - d + z) / ((n - 1) * (k - 1))) / ((a - z) / (n - 1)), 6) + 0.0 AS icc3k FROM p JOIN i USING (part) JOIN t USING (part) WHERE n > 1 AND k > 1""")
def icc_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    out = reliability.icc_by_part(_grouped_cells(spark, sf), "who", "item", "ff", PARTS)
    return rounded_all(out.select("part", "items", "people", "icc3k"), 6, "icc3k")


# -- preparation -------------------------------------------------------------------------------------------------------


@query(W + """, a AS (SELECT participant_id, avg(ff) ff FROM words0 WHERE ptb_pos = 'A' GROUP BY 1), b AS (SELECT participant_id, avg(fp) fp FROM words0 WHERE ptb_pos = 'N' GROUP BY 1)
SELECT coalesce(a.participant_id, b.participant_id) AS participant_id, round(ff + 3e-6, 4) + 0.0 AS ff, round(fp + 3e-6, 4) + 0.0 AS fp FROM a FULL JOIN b ON a.participant_id = b.participant_id""")
def feature_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Requested feature groups side by side, a reader with either kept."""
    w = roles.words(spark, sf, numbered=False)
    frames = {c: features.metric_means(w.where(F.col("ptb_pos") == t), ["participant_id"], {c: c}) for c, t in (("ff", "A"), ("fp", "N"))}
    return rounded_all(features.feature_groups(frames, ["participant_id"]), 4, "ff", "fp")


@query(W + """ SELECT participant_id, paragraph, 'flags' AS feature_group, ptb_pos || '_' || universal_pos AS cell, count(*)::DOUBLE AS value FROM words0 GROUP BY ALL
UNION ALL SELECT participant_id, paragraph, 'lines', line::VARCHAR, round(avg(ff), 4) FROM words0 GROUP BY ALL""")
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False)
    flags = w.groupBy("participant_id", "paragraph", "ptb_pos", "universal_pos").agg(F.count(F.lit(1)).alias("value"))
    lines = w.groupBy("participant_id", "paragraph", "line").agg(F.round(F.avg("ff"), 4).alias("value"))
    return features.text_features({"flags": flags, "lines": lines}, ["participant_id"], "paragraph")


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer),
k AS (SELECT * FROM c WHERE (c_mktsegment, c_nationkey) IN (SELECT 'BUILDING', n_nationkey FROM nation WHERE n_nationkey % 2 = 0))
SELECT c_custkey, c_nationkey - 1 AS place, CASE WHEN c_nationkey % 3 = 0 THEN 1 WHEN c_nationkey % 3 = 1 THEN 0 END AS level, CASE WHEN c_nationkey = 4 THEN 'eng' ELSE 'n' || c_nationkey END AS code,
  coalesce(CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 1) END, -1.0)::DOUBLE AS score, -1.0::DOUBLE AS other FROM k""")
def prepared_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Shown cells only; places from zero, levels as numbers, a proxy language, gaps as the sentinel."""
    shown = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.lit("BUILDING").alias("c_mktsegment"), F.col("n_nationkey").alias("c_nationkey"))
    c = filters.displayed(table(spark, sf, "customer"), shown)
    level = F.when(F.col("c_nationkey") % 3 == 0, "Adv").when(F.col("c_nationkey") % 3 == 1, "Ele").otherwise("-")
    c = c.withColumns({"level": level, "code": F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "component": F.lit("scriptural"), "place": F.col("c_nationkey"), "score": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))})
    tests = scalars.proficiency(c, "c_custkey", ["score"], ["other"], digits=1)
    c = scalars.from_zero(c, "place").select("c_custkey", "place", scalars.level_code("level").alias("level"), scalars.proxy_code("component", "code", {"n4": "eng"}).alias("code"))
    return c.join(tests, "c_custkey")
