"""Prototype scores, their correction and predictions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.operators import debias, distances, features, models, schemes, scoring, splits
from fovea.plans import roles
from fovea.plans.registry import least_squares, query, rounded, rounded_all
from fovea.sources import table
from fovea.sources.shared import keep

FEATURES = ("ff", "fp", "tf", "rp", "sk", "rr")
# A made-up distance by nation number stands in for a typological one; the tables have no languages.
DISTANCE = "((n * 7) % 25) / 25.0"

_WIDE = roles.SQL + """, wide AS (
  SELECT participant_id, avg(ff) ff, avg(fp) fp, avg(tf) tf, avg(rp) rp, avg(sk) sk, avg(rr) rr FROM words0 GROUP BY 1),
lng AS (SELECT m.*, f.feature, f.value FROM meta m JOIN (UNPIVOT wide ON ff, fp, tf, rp, sk, rr INTO NAME feature VALUE value) f USING (participant_id))"""
_SCORES = _WIDE + """, st AS (SELECT feature, avg(value) m, stddev_samp(value) s FROM lng WHERE NOT native GROUP BY 1 HAVING stddev_samp(value) > 0),
z AS (SELECT lng.*, (value - m) / s z FROM lng JOIN st USING (feature)),
pr AS (SELECT feature, avg(z) p FROM z WHERE native GROUP BY 1),
sc AS (SELECT participant_id, any_value(L1) L1, any_value(score) score, any_value(content_group) content_group, any_value(lang_no) lang_no,
  sum(z * p) / sqrt(sum(z * z) * sum(p * p)) eye_score FROM z JOIN pr USING (feature) WHERE NOT native GROUP BY 1),
ds AS (SELECT *, ((lang_no * 7) % 25) / 25.0 AS distance FROM sc)"""


def wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row a reader: metric means and what is known about them. Kept, so each query reads the line items once."""
    wide = features.metric_means(roles.words(spark, sf, numbered=False), ["participant_id"], {m: m for m in FEATURES})
    return keep(wide.join(roles.readers(spark, sf), "participant_id"))


def feature_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Long features of second-language and native readers, with what is known about them."""
    about = ["participant_id", "L1", "native", "region", "score", "content_group", "lang_no"]
    long = scoring.long_features(wide_rows(spark, sf), about, FEATURES).where("value is not null")
    return long.where("not native"), long.where("native")


def scores(spark: SparkSession, sf: str, how: str = "cosine") -> DataFrame:
    """A row a second-language reader with the score; kept, as corrections use it for sums and for rows."""
    second, native = feature_rows(spark, sf)
    found = scoring.prototype_scores(second, native, ["participant_id"], how=how)
    return keep(found.join(roles.readers(spark, sf), "participant_id"))


def with_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", ((F.col("lang_no") * 7) % 25) / F.lit(25.0))


@query(_SCORES + " SELECT participant_id, L1, score, round(eye_score, 6) + 0.0 AS eye_score FROM sc")
def prototype_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("participant_id", "L1", "score", rounded("eye_score").alias("eye_score"))


@query(_SCORES + """ SELECT participant_id, round(-sqrt(sum((z - p) * (z - p))), 6) + 0.0 AS eye_score FROM z JOIN pr USING (feature) WHERE NOT native GROUP BY 1""")
def prototype_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf, "euclidean").select("participant_id", rounded("eye_score").alias("eye_score"))


@query(_WIDE + """, t AS (SELECT feature, count(*) n, avg(value) m, var_pop(value) * count(*) q FROM lng WHERE NOT native GROUP BY 1),
nv AS (SELECT feature, avg(value) v FROM lng WHERE native GROUP BY 1),
o AS (SELECT participant_id, feature, value, (m * n - value) / (n - 1) lm, sqrt(greatest(q - (value - m) * (value - (m * n - value) / (n - 1)), 0) / (n - 2)) ls, v
  FROM lng JOIN t USING (feature) JOIN nv USING (feature) WHERE NOT native),
zz AS (SELECT participant_id, (value - lm) / ls z, (v - lm) / ls p FROM o WHERE ls > 1e-12)
SELECT participant_id, round(sum(z * p) / sqrt(sum(z * z) * sum(p * p)), 6) + 0.0 AS eye_score FROM zz GROUP BY 1""")
def loo_cosine(spark: SparkSession, sf: str) -> DataFrame:
    second, native = feature_rows(spark, sf)
    return rounded_all(scoring.leave_one_out_cosine(second.select("participant_id", "feature", "value"), native, "participant_id"), 6, "eye_score")


@query(_WIDE + """, st AS (SELECT content_group g, feature, avg(value) m, stddev_samp(value) s FROM lng WHERE NOT native GROUP BY 1, 2 HAVING stddev_samp(value) > 0),
pr AS (SELECT 'SEEN' pool, g, st.feature, avg((value - m) / s) p FROM lng JOIN st ON lng.feature = st.feature AND content_group = g WHERE native GROUP BY ALL
  UNION ALL SELECT 'UNSEEN', g, st.feature, avg((value - m) / s) FROM lng JOIN st ON lng.feature = st.feature AND content_group <> g WHERE native GROUP BY ALL
  UNION ALL SELECT 'ALL', g, st.feature, avg((value - m) / s) FROM lng JOIN st ON lng.feature = st.feature WHERE native GROUP BY ALL),
zz AS (SELECT participant_id, g, st.feature, (value - m) / s z FROM lng JOIN st ON lng.feature = st.feature AND content_group = g WHERE NOT native)
SELECT participant_id, zz.g AS content_group, pool, round(sum(z * p) / sqrt(sum(z * z) * sum(p * p)), 6) + 0.0 AS eye_score
FROM zz JOIN pr ON zz.g = pr.g AND zz.feature = pr.feature GROUP BY 1, 2, 3""")
def seen_unseen_cosine(spark: SparkSession, sf: str) -> DataFrame:
    second, native = feature_rows(spark, sf)
    out = scoring.by_pool(second, native, "participant_id", "content_group", ("ALL", "SEEN", "UNSEEN"))
    return rounded_all(out, 6, "eye_score")


@query("""
WITH v AS (SELECT vec_id, label, embedding e FROM embeddings), l AS (SELECT vec_id, label, unnest(e)::DOUBLE x, generate_subscripts(e, 1) i FROM v),
p AS (SELECT label, i, avg(x) p FROM l GROUP BY 1, 2)
SELECT vec_id, l.label, round(sum(x * p) / sqrt(sum(x * x) * sum(p * p)), 6) + 0.0 AS similarity FROM l JOIN p ON l.label = p.label AND l.i = p.i GROUP BY 1, 2""")
def embedding_prototype(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feature", "x")).withColumn("z", F.col("x").cast("double"))
    proto = long.groupBy("label", "feature").agg(F.avg("z").alias("p"))
    return scoring.cosine(long, proto, ["vec_id", "label"], ["label"]).select("vec_id", "label", rounded("eye_score").alias("similarity"))


@query(_SCORES + """, a AS (SELECT regr_slope(eye_score, score) b, regr_intercept(eye_score, score) c FROM ds)
SELECT count(*) AS n, round(regr_slope(eye_score - c - b * score, distance), 6) + 0.0 AS alpha, round(avg(distance), 6) AS mean_distance FROM ds, a""")
def two_step_slope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(debias.alpha(with_distance(scores(spark, sf)), "eye_score", "score"), 6, "alpha", "mean_distance")


_ACROSS = _SCORES + """, la AS (SELECT DISTINCT L1 fold FROM ds),
tr AS (SELECT fold, ds.* FROM la JOIN ds ON L1 <> fold)"""


@query(_ACROSS + """, a AS (SELECT fold, regr_slope(eye_score, score) b, regr_intercept(eye_score, score) c FROM tr GROUP BY 1),
r AS (SELECT fold, regr_slope(eye_score - c - b * score, distance) alpha FROM tr JOIN a USING (fold) GROUP BY 1)
SELECT participant_id, L1, round(alpha, 6) + 0.0 AS alpha, round(eye_score - alpha * distance, 6) + 0.0 AS debiased FROM ds JOIN r ON L1 = fold""")
def debias_across(spark: SparkSession, sf: str) -> DataFrame:
    df = debias.debias_by_fold(with_distance(scores(spark, sf)), "eye_score", "score", "L1")
    return rounded_all(df.select("participant_id", "L1", "alpha", "debiased"), 6, "alpha", "debiased")


@query(_ACROSS + """, r AS (SELECT fold, (covar_pop(eye_score, distance) * var_pop(score) - covar_pop(eye_score, score) * covar_pop(score, distance))
    / (var_pop(score) * var_pop(distance) - covar_pop(score, distance) * covar_pop(score, distance)) alpha, avg(distance) c FROM tr GROUP BY 1)
SELECT participant_id, L1, round(alpha, 6) + 0.0 AS alpha, round(eye_score - alpha * (distance - c), 6) + 0.0 AS debiased FROM ds JOIN r ON L1 = fold""")
def distance_mreg(spark: SparkSession, sf: str) -> DataFrame:
    df = debias.debias_by_fold(with_distance(scores(spark, sf)), "eye_score", "score", "L1", how="distance_mreg", centre=True)
    return rounded_all(df.select("participant_id", "L1", "alpha", "debiased"), 6, "alpha", "debiased")


@query()
def debias_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Folds stratified by language, as many as there are languages."""
    df = with_distance(scores(spark, sf))
    k = max(2, df.select(F.countDistinct("L1")).first()[0])
    folds = splits.stratified_folds(df, "participant_id", "L1", k)
    return debias.debias_by_fold(df.join(folds.select("participant_id", "fold"), "participant_id"), "eye_score", "score", "fold").select("participant_id", "L1", "fold", "alpha", "debiased")


@query(_SCORES + """, q AS (SELECT content_group, eye_score AS y, score - avg(score) OVER w AS t, distance - avg(distance) OVER w AS d FROM ds WINDOW w AS (PARTITION BY content_group)), q2 AS (SELECT *, t * d AS td FROM q), """
  + least_squares("q2", "content_group", "y", ["t", "d", "td"]) + " SELECT content_group, n AS n_rows, round(b_0, 6) + 0.0 AS b_0, round(b_1, 9) + 0.0 AS b_t, round(b_2, 6) + 0.0 AS b_d, round(b_3, 9) + 0.0 AS b_td FROM ls")
def interaction_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = debias.interaction(with_distance(scores(spark, sf)), "eye_score", "score", ["content_group"])
    return rounded_all(rounded_all(out, 6, "b_0", "b_d"), 9, "b_t", "b_td")


@query(_SCORES + """, w AS (SELECT L1, avg(eye_score) my, avg(score) mt, regr_sxx(eye_score, score) sxx, regr_sxy(eye_score, score) sxy FROM ds GROUP BY 1),
b AS (SELECT sum(sxy) / sum(sxx) s FROM w), e AS (SELECT L1, my - s * mt r FROM w, b), c AS (SELECT avg(r) a FROM e)
SELECT participant_id, L1, round(eye_score - (r - a), 6) + 0.0 AS debiased FROM ds JOIN e USING (L1), c""")
def fixed_l1(spark: SparkSession, sf: str) -> DataFrame:
    df = with_distance(scores(spark, sf))
    out = debias.without_effects(df, debias.language_effects(df, "eye_score", "score"), "eye_score")
    return rounded_all(out.select("participant_id", "L1", "debiased"), 6, "debiased")


@query()
def random_l1(spark: SparkSession, sf: str) -> DataFrame:
    df = with_distance(scores(spark, sf))
    return debias.without_effects(df, debias.language_effects(df, "eye_score", "score", how="random"), "eye_score").select("participant_id", "L1", "debiased")


@query(_SCORES + """, g AS (SELECT L1, count(*) n, avg(eye_score) m, var_pop(eye_score) * count(*) q FROM ds GROUP BY 1),
t AS (SELECT count(*) k, sum(n) n, sum(q) w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) b FROM g)
SELECT k AS langs, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS f FROM t""")
def l1_ftest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(debias.language_anova(scores(spark, sf), "eye_score").select("langs", "n", "f"), 6, "f")


@query(_SCORES + """ SELECT content_group, count(*) AS n, round(regr_slope(eye_score, distance), 6) + 0.0 AS slope, round(corr(eye_score, distance), 6) + 0.0 AS r FROM ds GROUP BY 1""")
def distance_slope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(debias.slope_test(with_distance(scores(spark, sf)), "eye_score", "distance", ["content_group"]).drop("p"), 6, "slope", "r")


@query("""
WITH c AS (SELECT n_name AS iso, component, d::DOUBLE AS d FROM (SELECT n_name, unnest(['syntax', 'sound', 'script']) component, unnest([(n_nationkey * 3) % 11, (n_nationkey * 5) % 13, (n_nationkey * 7) % 17]) d FROM nation)),
r AS (SELECT component, avg(d) m, stddev_pop(d) s, min(d) lo, max(d) hi FROM c GROUP BY 1),
x AS (SELECT c.*, m, s, lo, hi FROM c JOIN r USING (component))
SELECT iso, round(avg(d) FILTER (component IN ('syntax', 'sound')), 6) AS raw, round(avg((d - m) / s), 6) + 0.0 AS z, round(avg((d - lo) / (hi - lo)), 6) + 0.0 AS mm,
  round(avg(d / hi), 6) + 0.0 AS mx, round(avg((greatest(-2, least(2, (d - m) / s)) + 2) / 4), 6) + 0.0 AS z2sd FROM x GROUP BY 1""")
def composite_distance(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    parts = F.map_from_arrays(F.array(*map(F.lit, ("syntax", "sound", "script"))), F.array((n * 3) % 11, (n * 5) % 13, (n * 7) % 17))
    t = table(spark, sf, "nation").select(F.col("n_name").alias("iso"), F.explode(parts).alias("component", "d")).select("iso", "component", F.col("d").cast("double").alias("distance"))
    out = None
    for name, kind in (("raw", "syntax+sound"), ("z", "z:syntax+sound+script"), ("mm", "mm:syntax+sound+script"), ("mx", "max:syntax+sound+script"), ("z2sd", "z2sd:syntax+sound+script")):
        one = distances.distance(t, kind).select("iso", rounded("distance").alias(name))
        out = one if out is None else out.join(one, "iso")
    return out


@query(_WIDE + """, s AS (SELECT region, sum(score) s, count(*) n FROM meta WHERE NOT native GROUP BY 1), t AS (SELECT sum(score) s, count(*) n FROM meta WHERE NOT native)
SELECT participant_id, round((t.s - score) / (t.n - 1), 6) + 0.0 AS loo, round((t.s - s.s) / (t.n - s.n), 6) + 0.0 AS by_fold FROM meta JOIN s USING (region), t WHERE NOT native""")
def mean_baseline_lopo(spark: SparkSession, sf: str) -> DataFrame:
    second = roles.readers(spark, sf).where("not native")
    both = models.fold_mean(models.leave_one_out_mean(second, "score", name="loo"), "score", "region", name="by_fold")
    return rounded_all(both.select("participant_id", "loo", "by_fold"), 6, "loo", "by_fold")


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return wide_rows(spark, sf).where("not native")


@query(_WIDE + """, f AS (SELECT participant_id, score y, ff x FROM wide JOIN meta USING (participant_id) WHERE NOT native),
t AS (SELECT count(*) n, sum(x) x, sum(x * x) xx, sum(y) sy, sum(x * y) xy FROM f),
l AS (SELECT participant_id, f.y "true", n - 1 n1, t.x - f.x x1, t.xx - f.x * f.x xx1, t.sy - f.y y1, t.xy - f.x * f.y xy1, f.x fx FROM f, t)
SELECT participant_id, "true", round((y1 - (n1 * xy1 - x1 * y1) / (n1 * xx1 - x1 * x1) * x1) / n1 + (n1 * xy1 - x1 * y1) / (n1 * xx1 - x1 * x1) * fx, 3) + 0.0 AS pred FROM l""")
def ols_press(spark: SparkSession, sf: str) -> DataFrame:
    out = models.press(_model_rows(spark, sf), "participant_id", "score", ["ff"])
    return out.select("participant_id", "true", rounded("pred", 3).alias("pred"))


@query()
def ridge_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language folds: each is fitted on the readers of all other nations, from sums."""
    return schemes.predicted_by_fold(_model_rows(spark, sf), "participant_id", "score", FEATURES, "L1")


_FILLED = [f"coalesce({f}, avg({f}) OVER (PARTITION BY fold)) AS {f}" for f in FEATURES]


@query(_WIDE + ", mr AS (SELECT * FROM wide JOIN meta USING (participant_id) WHERE NOT native), tr0 AS (SELECT fold, mr.* FROM (SELECT DISTINCT L1 AS fold FROM mr) k JOIN mr ON L1 <> fold), tr AS (SELECT fold, score, " + ", ".join(_FILLED) + " FROM tr0), "
  + least_squares("tr", "fold", "score", list(FEATURES)) + ", mn AS (SELECT fold, " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM tr0 GROUP BY fold) "
  + """SELECT L1, participant_id, score AS "true", round(b_0""" + "".join(f" + b_{i + 1} * coalesce({f}, m_{f})" for i, f in enumerate(FEATURES)) + ", 2) + 0.0 AS pred FROM mr JOIN ls ON L1 = ls.fold JOIN mn ON L1 = mn.fold")
def ols_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on all metrics for each language from all others; a gap counts as the others' mean."""
    out = schemes.predicted_by_fold(_model_rows(spark, sf), "participant_id", "score", FEATURES, "L1", model="ols")
    return rounded_all(out, 2, "pred")


@query()
def logistic_native_scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_rows(spark, sf).select("participant_id", F.col("native").cast("int").alias("native"), "content_group", F.pmod(F.xxhash64("participant_id"), F.lit(5)).cast("int").alias("fold"), *FEATURES)
    return scoring.discriminative_scores(wide, "participant_id", "native", "fold", FEATURES, ["content_group"])


@query()
def lda_native_scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_rows(spark, sf).select("participant_id", F.col("native").cast("int").alias("native"), "content_group", F.pmod(F.xxhash64("participant_id"), F.lit(5)).cast("int").alias("fold"), *FEATURES)
    return scoring.discriminative_scores(wide, "participant_id", "native", "fold", FEATURES, ["content_group"], how="lda")


@query()
def forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("test", F.pmod(F.xxhash64("participant_id"), F.lit(5)) == 0)
    out = models.tree_predictions(rows.where("not test"), rows.where("test"), "score", FEATURES, trees=200)
    return out.select("participant_id", F.col("score").alias("true"), "pred")


@query()
def crossfit_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return models.crossfit_ridge(_model_rows(spark, sf), "participant_id", "score", FEATURES, ["region"], "L1")


@query()
def debias_gain(spark: SparkSession, sf: str) -> DataFrame:
    return debias.delta_r_bootstrap(with_distance(scores(spark, sf)), "eye_score", "score", ["content_group"], who="participant_id")


# -- both directions between halves --------------------------------------------------------------------------------------

_PARTED = roles.SQL + """, h AS (SELECT participant_id, CASE WHEN paragraph <= 3 THEN 1 ELSE 2 END AS part, paragraph % 2 AS side, avg(ff) ff, avg(fp) fp, avg(tf) tf, avg(rp) rp, avg(sk) sk, avg(rr) rr FROM words0 GROUP BY 1, 2, 3),
l AS (SELECT native, L1, score, lang_no, u.* FROM (UNPIVOT h ON ff, fp, tf, rp, sk, rr INTO NAME feature VALUE value) u JOIN meta USING (participant_id)),
st AS (SELECT part, side, feature, avg(value) m, stddev_samp(value) s FROM l WHERE NOT native GROUP BY 1, 2, 3 HAVING stddev_samp(value) > 0),
pr AS (SELECT part, side, feature, (avg(value) - any_value(m)) / any_value(s) p FROM l JOIN st USING (part, side, feature) WHERE native GROUP BY 1, 2, 3),
z AS (SELECT participant_id, L1, score, lang_no, l.part, pool, pr.side AS direction, (value - m) / s AS z, p
  FROM l, (VALUES ('SEEN'), ('UNSEEN')) v(pool), pr, st WHERE NOT native AND l.part = pr.part AND l.feature = pr.feature AND pr.side = CASE pool WHEN 'SEEN' THEN l.side ELSE 1 - l.side END
  AND st.part = pr.part AND st.side = pr.side AND st.feature = pr.feature),
d AS (SELECT participant_id, L1, score, lang_no, part, pool, direction, sum(z * p) / sqrt(sum(z * z) * sum(p * p)) AS e, ((lang_no * 7) % 25) / 25.0 AS distance FROM z GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def _directions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of second-language readers by part of the text, pool and direction between its odd and even paragraphs."""
    w = roles.words(spark, sf, numbered=False).withColumns({"part": F.when(F.col("paragraph") <= 3, 1).otherwise(2), "side": F.col("paragraph") % 2})
    wide = keep(features.metric_means(w, ["participant_id", "part", "side"], {m: m for m in FEATURES}).join(roles.readers(spark, sf).select("participant_id", "native"), "participant_id"))
    long = scoring.long_features(wide, ["participant_id", "part", "side", "native"], FEATURES).where("value is not null")
    return scoring.direction_scores(long.where("not native"), long.where("native"), "participant_id", "side", ["part"])


@query(_PARTED + " SELECT participant_id, part, pool, count(e) AS directions, round(avg(e), 6) + 0.0 AS eye_score FROM d GROUP BY 1, 2, 3")
def direction_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Seen and unseen halves in both directions, averaged to one row a reader, part and pool."""
    found = _directions(spark, sf).groupBy("participant_id", "part", "pool").agg(F.count("eye_score").alias("directions"), F.avg("eye_score").alias("eye_score"))
    return rounded_all(found, 6, "eye_score")


@query(_PARTED + """, k AS (SELECT DISTINCT L1 AS fold FROM d), x AS (SELECT fold, d.* FROM k JOIN d ON d.L1 <> fold WHERE e IS NOT NULL),
a AS (SELECT part, pool, direction, fold, regr_slope(e, score) b, regr_intercept(e, score) c FROM x GROUP BY 1, 2, 3, 4),
r AS (SELECT part, pool, direction, fold, regr_slope(e - c - b * score, distance) AS alpha FROM x JOIN a USING (part, pool, direction, fold) GROUP BY 1, 2, 3, 4)
SELECT participant_id, part, pool, round(avg(e - alpha * distance), 5) + 0.0 AS debiased FROM (SELECT *, L1 AS fold FROM d) d JOIN r USING (part, pool, direction, fold) GROUP BY 1, 2, 3""")
def direction_debiased(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected inside each direction by fits outside the reader's language, then averaged over directions."""
    found = keep(_directions(spark, sf).where("eye_score is not null").join(roles.readers(spark, sf), "participant_id"))
    out = debias.debias_by_fold(with_distance(found), "eye_score", "score", "L1", groups=["part", "pool", "direction"])
    return rounded_all(out.groupBy("participant_id", "part", "pool").agg(F.avg("debiased").alias("debiased")), 5, "debiased")


_BY_ITEM = roles.SQL + """, h AS (SELECT participant_id, paragraph, avg(ff) ff, avg(fp) fp, avg(tf) tf, avg(rp) rp, avg(sk) sk, avg(rr) rr FROM words0 GROUP BY 1, 2),
l AS (SELECT native, u.*, paragraph % 2 AS side FROM (UNPIVOT h ON ff, fp, tf, rp, sk, rr INTO NAME feature VALUE value) u JOIN meta USING (participant_id)),
r AS (SELECT * FROM l WHERE NOT native),
seen AS (SELECT participant_id, paragraph, feature, value, count(*) OVER w - 1 AS n, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS m, sum(value * value) OVER w - value * value AS q FROM r WINDOW w AS (PARTITION BY paragraph, feature)),
own AS (SELECT participant_id, side, feature, count(*) c, sum(value) t, sum(value * value) u FROM r GROUP BY 1, 2, 3),
tot AS (SELECT side, feature, count(*) c, sum(value) t, sum(value * value) u FROM r GROUP BY 1, 2),
unseen AS (SELECT r.participant_id, r.paragraph, r.side, r.feature, r.value, tot.c - own.c AS n, (tot.t - own.t) / (tot.c - own.c) AS m, tot.u - own.u AS q FROM r JOIN own USING (participant_id, side, feature) JOIN tot USING (side, feature) WHERE tot.c - own.c > 1),
ns AS (SELECT paragraph, feature, avg(value) p FROM l WHERE native GROUP BY 1, 2), nu AS (SELECT side, feature, avg(value) p FROM l WHERE native GROUP BY 1, 2),
c AS (SELECT 'SEEN' AS pool, participant_id, paragraph, value, m, sqrt((q - n * m * m) / (n - 1)) AS s, p FROM seen JOIN ns USING (paragraph, feature) WHERE n > 1
  UNION ALL SELECT 'UNSEEN', participant_id, paragraph, value, m, sqrt((q - n * m * m) / (n - 1)), p FROM unseen JOIN nu ON nu.side = 1 - unseen.side AND nu.feature = unseen.feature)"""


@query(_BY_ITEM + """, e AS (SELECT pool, participant_id, paragraph, sum((value - m) / s * (p - m) / s) / sqrt(sum(((value - m) / s) * ((value - m) / s)) * sum(((p - m) / s) * ((p - m) / s))) AS e FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT pool, participant_id, count(*) AS items, round(avg(e), 5) + 0.0 AS eye_score FROM e GROUP BY 1, 2""")
def item_direction_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Items by parity, each scored without its reader, averaged over items and directions."""
    w = roles.words(spark, sf, numbered=False)
    wide = keep(features.metric_means(w, ["participant_id", "paragraph"], {m: m for m in FEATURES}).join(roles.readers(spark, sf).select("participant_id", "native"), "participant_id").withColumn("side", F.col("paragraph") % 2))
    long = scoring.long_features(wide, ["participant_id", "paragraph", "side", "native"], FEATURES).where("value is not null")
    found = scoring.item_direction_scores(long.where("not native"), long.where("native"), "participant_id", "paragraph", "side")
    return rounded_all(found.groupBy("pool", "participant_id").agg(F.count(F.lit(1)).alias("items"), F.avg("eye_score").alias("eye_score")), 5, "eye_score")
