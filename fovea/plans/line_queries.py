"""Cross-validated fits on one column, whose closed forms SQL can check; and how rows get to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.functions import scalars
from fovea.operators import debias, distances, filters, joins, models, schemes, scoring, splits, windows
from fovea.plans import roles
from fovea.plans.registry import query, rounded, rounded_all
from fovea.plans.score_queries import _SCORES, _model_rows, scores, wide_rows, with_distance
from fovea.plans.scheme_queries import _items
from fovea.plans.stat_queries import _WIDE2
from fovea.sources import table
from fovea.sources.shared import keep

W = roles.SQL
_ALPHAS = "al(alpha) AS (VALUES " + ", ".join(f"({a!r}::DOUBLE)" for a in map(float, models.ALPHAS)) + ")"


def _ridge_sql(rows: str, train: str, test: str, keys: str, what: str, left_out: bool = False, digits: int | None = 3) -> str:
    """Ridge on one column: `train` and `test` name relations of keys, x, y (and what is reported). The alpha is that of
    least leave-one-out error; `left_out` predicts the training rows themselves, each by the others."""
    z = "(x - m) / s"
    fit = f"my + {z} * zy / (zz + alpha)"
    pred = f"y - (y - ({fit})) / (1 - 1.0 / n - ({z}) * ({z}) / (zz + alpha))" if left_out else fit
    shown = f"round({pred}, {digits}) + 0.0" if digits else pred
    return f"""{rows}, {_ALPHAS},
st AS (SELECT {keys}, count(*) n, avg(x) m, CASE WHEN var_samp(x) > 1e-12 * greatest(1, avg(x) * avg(x)) THEN stddev_samp(x) ELSE 1 END s, avg(y) my FROM {train} GROUP BY {keys}),
zs AS (SELECT {keys}, any_value(n) n, any_value(m) m, any_value(s) s, any_value(my) my, sum(({z}) * ({z})) zz, sum(({z}) * (y - my)) zy FROM {train} JOIN st USING ({keys}) GROUP BY {keys}),
er AS (SELECT {keys}, alpha, sum(pow((y - ({fit})) / (1 - 1.0 / n - ({z}) * ({z}) / (zz + alpha)), 2)) e FROM {train} JOIN zs USING ({keys}), al GROUP BY {keys}, alpha),
ch AS (SELECT {keys}, arg_min(alpha, e) AS alpha FROM er GROUP BY {keys})
SELECT {what}, y AS "true", {shown} AS pred FROM {test} JOIN zs USING ({keys}) JOIN ch USING ({keys})"""


_ONE = _WIDE2 + """, r AS (SELECT participant_id, L1, region, content_group, ff AS x, score AS y FROM mr)"""


def _reported(out: DataFrame, *names: str) -> DataFrame:
    return out.select(*names, "true", rounded("pred", 3).alias("pred"))


@query(_ridge_sql(_ONE + ", k AS (SELECT DISTINCT L1 AS fold FROM r), tr AS (SELECT fold, x, y FROM k JOIN r ON L1 <> fold), te AS (SELECT L1 AS fold, participant_id, x, y FROM r)", "tr", "te", "fold", "fold AS L1, participant_id"))
def ridge_line_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Each language by ridge on all others, the penalty chosen by exact leave-one-out errors."""
    return _reported(schemes.predicted_by_fold(_model_rows(spark, sf), "participant_id", "score", ["ff"], "L1"), "L1", "participant_id")


@query(_ridge_sql(_ONE + ", g AS (SELECT * FROM r WHERE L1 IN (SELECT L1 FROM r GROUP BY 1 HAVING count(*) >= 8)), tr AS (SELECT a.participant_id, b.x, b.y FROM g a JOIN g b ON a.L1 = b.L1 AND a.participant_id <> b.participant_id)", "tr", "g", "participant_id", "L1, participant_id"))
def nested_line(spark: SparkSession, sf: str) -> DataFrame:
    """Leave one reader out of a language of eight or more; scale and penalty anew for each."""
    return _reported(schemes.ridge_leave_one_out("nested", splits.large_strata(_model_rows(spark, sf), "L1", 8), "participant_id", "score", ["ff"], ["L1"], "content_group"), "L1", "participant_id")


@query(_ridge_sql(_ONE + ", tr AS (SELECT region, x, y FROM r WHERE content_group < 'F'), te AS (SELECT region, participant_id, x, y FROM r WHERE content_group >= 'F')", "tr", "te", "region", "region, participant_id"))
def direct_line(spark: SparkSession, sf: str) -> DataFrame:
    """Some content groups of a region predicted from one fit on the others."""
    rows = _model_rows(spark, sf).withColumn("role", F.when(F.col("content_group") < "F", "train").otherwise("test"))
    return _reported(schemes.direct_ridge(rows, "participant_id", "score", ["ff"], ["region"]), "region", "participant_id")


@query(_ONE + f""", {_ALPHAS}, h AS (SELECT *, (row_number() OVER (PARTITION BY region, content_group ORDER BY participant_id) - 1) % 2 AS half FROM r),
st AS (SELECT region, 1 - half AS half, count(*) n, avg(x) m, stddev_samp(x) s, avg(y) my FROM h GROUP BY 1, 2),
zo AS (SELECT region, st.half, any_value(n) n, any_value(m) m, any_value(s) s, any_value(my) my, sum(pow((x - m) / s, 2)) zz, sum((x - m) / s * (y - my)) zy FROM h JOIN st USING (region) WHERE h.half <> st.half GROUP BY 1, 2),
er AS (SELECT region, zo.half, alpha, sum(pow((y - my - (x - m) / s * zy / (zz + alpha)) / (1 - 1.0 / n - pow((x - m) / s, 2) / (zz + alpha)), 2)) e FROM h JOIN zo USING (region), al WHERE h.half <> zo.half GROUP BY 1, 2, 3),
ch AS (SELECT region, half, arg_min(alpha, e) AS alpha FROM er GROUP BY 1, 2),
al1 AS (SELECT region, ch.half, any_value(alpha) alpha, count(*) n, any_value(m) m, any_value(s) s, avg(y) my, avg((x - m) / s) zm, var_pop((x - m) / s) * count(*) zz, covar_pop((x - m) / s, y) * count(*) zy FROM h JOIN ch USING (region) JOIN zo ON zo.region = h.region AND zo.half = ch.half GROUP BY 1, 2)
SELECT region, participant_id, y AS "true", round(y - (y - my - ((x - m) / s - zm) * zy / (zz + alpha)) / (1 - 1.0 / n - pow((x - m) / s - zm, 2) / (zz + alpha)), 3) + 0.0 AS pred FROM h JOIN al1 USING (region, half)""")
def crossfit_line(spark: SparkSession, sf: str) -> DataFrame:
    """Leave one reader out of the region with the scale and penalty of the other half."""
    return _reported(schemes.ridge_leave_one_out("crossfit", _model_rows(spark, sf), "participant_id", "score", ["ff"], ["region"], "content_group"), "region", "participant_id")


_IT = W + """, it AS (SELECT participant_id, paragraph, avg(ff) x, any_value(score) y, participant_id % 3 AS fold FROM words0 JOIN meta USING (participant_id) WHERE NOT native GROUP BY 1, 2)"""


@query(_ridge_sql(_IT, "it", "it", "paragraph", "paragraph, participant_id", left_out=True))
def items_seen_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Leave one reader out inside each item, with the item's penalty."""
    return _reported(schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "SEEN", model="ridge"), "paragraph", "participant_id")


@query(_ridge_sql(_IT + ", k AS (SELECT DISTINCT paragraph, fold FROM it), tr AS (SELECT k.paragraph, k.fold, x, y FROM k JOIN it ON it.paragraph <> k.paragraph AND it.fold <> k.fold)", "tr", "it", "paragraph, fold", "paragraph, participant_id"))
def items_unseen_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """From other readers' other items, by ridge."""
    return _reported(schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "UNSEEN", model="ridge"), "paragraph", "participant_id")


@query(_ridge_sql(_IT + ", k AS (SELECT DISTINCT paragraph, fold FROM it), tr AS (SELECT k.paragraph, k.fold, x, y FROM k JOIN it ON it.paragraph = k.paragraph AND it.fold <> k.fold)", "tr", "it", "paragraph, fold", "paragraph, participant_id", digits=None).replace("SELECT paragraph, participant_id, y AS", "SELECT participant_id, count(*) AS items, any_value(\"true\") AS \"true\", round(avg(pred), 2) + 0.0 AS pred FROM (SELECT paragraph, participant_id, y AS") + ") GROUP BY 1")
def items_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated inside each item, then averaged to one row a reader."""
    found = schemes.per_item(_items(spark, sf), "participant_id", "y", ["x"], "paragraph", "INDEPENDENT", model="ridge")
    out = models.combined_segments(found.withColumn("one", F.lit(1)), "participant_id").join(found.groupBy("participant_id").agg(F.count(F.lit(1)).alias("items")), "participant_id")
    return out.select("participant_id", "items", "true", rounded("pred", 2).alias("pred"))


@query(_WIDE2 + """, w AS (SELECT participant_id, content_group, native::INT AS y, ff AS x, participant_id % 5 AS fold FROM wide JOIN meta USING (participant_id)), k AS (SELECT DISTINCT content_group, fold FROM w),
tr AS (SELECT k.content_group, k.fold, x, y FROM k JOIN w ON w.content_group = k.content_group AND w.fold <> k.fold),
st AS (SELECT content_group, fold, avg(x) m, stddev_samp(x) s, avg(y) q FROM tr GROUP BY 1, 2),
ab AS (SELECT content_group, fold, any_value(m) m, any_value(s) s, any_value(q) q, avg((x - m) / s) FILTER (y = 1) a, avg((x - m) / s) FILTER (y = 0) b FROM tr JOIN st USING (content_group, fold) GROUP BY 1, 2),
v AS (SELECT content_group, fold, any_value(m) m, any_value(s) s, any_value(q) q, any_value(a) a, any_value(b) b, avg(pow((x - m) / s - CASE y WHEN 1 THEN a ELSE b END, 2)) v FROM tr JOIN ab USING (content_group, fold) GROUP BY 1, 2)
SELECT content_group, participant_id, round(((x - m) / s - (a + b) / 2) * (a - b) / v + ln(q / (1 - q)), 5) + 0.0 AS eye_score FROM w JOIN v USING (content_group, fold)""")
def lda_line(spark: SparkSession, sf: str) -> DataFrame:
    """Discriminant scores on one column, where shrinking changes nothing."""
    rows = wide_rows(spark, sf).withColumns({"label": F.col("native").cast("int"), "fold": F.col("participant_id") % 5})
    out = scoring.discriminative_scores(rows, "participant_id", "label", "fold", ["ff"], ["content_group"], "lda")
    return rounded_all(out, 5, "eye_score")


# -- how rows get there --------------------------------------------------------------------------------------------------


@query(W + """ SELECT participant_id, paragraph, order_key, line, universal_pos IN ('PROPN', 'NOUN', 'VERB', 'ADV', 'ADJ') AS content, round(rr / nullif(ff - 1, 0), 6) + 0.0 AS regressions, round(fp / sum(fp) OVER (PARTITION BY trial), 6) + 0.0 AS share,
  (row_number() OVER (PARTITION BY trial ORDER BY order_key, line, part_key, supp_key, ff, fp, surprisal, frequency, ship_date, ptb_pos, universal_pos) - 1) % 2 AS side FROM words0""")
def prepared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Content words, regression rate, share of the trial's dwell, and sides in turn."""
    w = roles.words(spark, sf)
    w = w.withColumns({"content": scalars.is_content_word("universal_pos"), "regressions": scalars.rate("rr", F.col("ff") - 1), "share": windows.share_of_total("fp", ["trial"])})
    out = windows.parity_split(w, ["trial"], ["word"]).select("participant_id", "paragraph", "order_key", "line", "content", "regressions", "share", F.col("side").cast("long").alias("side"))
    return rounded_all(out, 6, "regressions", "share")


@query("""
WITH o AS (SELECT o_custkey AS who, month(o_orderdate) AS item, o_orderstatus, o_orderkey % 2 AS question_preview FROM orders),
k AS (SELECT * FROM o WHERE item <= 6 AND o_orderstatus = 'F' AND question_preview = 1),
h AS (SELECT who, CASE WHEN item % 2 = 1 THEN 'odd' ELSE 'even' END AS half, count(DISTINCT item) AS n FROM k GROUP BY 1, 2),
g AS (SELECT who FROM h GROUP BY 1 HAVING min(n) >= 1 AND count(*) = 2)
SELECT who, half, n AS n_paragraphs FROM h JOIN g USING (who)""")
def filtered_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Early items of one condition by half, of readers with enough of them in both."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("who"), F.month("o_orderdate").alias("item"), "o_orderstatus", (F.col("o_orderkey") % 2).alias("question_preview"))
    kept = filters.trials(filters.preview(filters.condition(o, o_orderstatus="F", absent=3), "Hunting"), "first_id", "who", ["item"], 6)
    halves = kept.withColumn("half", scalars.half_of("item")).groupBy("who", "half").agg(F.countDistinct("item").alias("n_paragraphs"))
    return filters.enough_paragraphs(halves, "who", 1)


@query(W + """, l AS (SELECT content_group, participant_id, part_key % 7 AS feature, avg(ff) AS value FROM words0 JOIN meta USING (participant_id) GROUP BY 1, 2, 3),
a AS (SELECT content_group, count(DISTINCT participant_id) n FROM l GROUP BY 1), c AS (SELECT content_group, feature FROM l JOIN a USING (content_group) GROUP BY content_group, feature, n HAVING count(DISTINCT participant_id) >= n),
s AS (SELECT content_group, feature, count(*) n, stddev_samp(value) sd FROM l GROUP BY 1, 2)
SELECT content_group, feature, n, c.feature IS NOT NULL AS everybody, round(sd, 6) + 0.0 AS sd FROM s LEFT JOIN c USING (content_group, feature) WHERE sd > 0""")
def feature_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Which features vary, and which everybody of the group has."""
    people = roles.readers(spark, sf).select("participant_id", "content_group")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("participant_id")).join(people, "participant_id")
    cells = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).cast("tinyint").alias("_feature"), F.col("l_quantity").alias("ff")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # kept: the statistics and the cover each read it
    long = keep(cells.groupBy("content_group", "participant_id", F.col("_feature").cast("long").alias("feature")).agg(F.avg("ff").alias("value")))
    full = filters.covered_features(long, "feature", "participant_id", "value", ["content_group"]).select("content_group", "feature").distinct().withColumn("everybody", F.lit(True))
    stats = filters.varying(scoring.feature_stats(long, ["content_group"]))
    out = stats.join(full, ["content_group", "feature"], "left").select("content_group", "feature", "n", F.coalesce("everybody", F.lit(False)).alias("everybody"), "sd")
    return rounded_all(out, 6, "sd")


@query(W + """, a AS (SELECT participant_id, sum(fp) AS score FROM words0 WHERE paragraph <= 4 GROUP BY 1)
SELECT CASE WHEN native THEN 'first' ELSE 'second' END AS cohort, L1, count(*) AS n, sum(CASE WHEN participant_id % 10 = 3 THEN 1 ELSE 0 END) AS repaired, round(avg(m.score), 2) + 0.0 AS balance, round(avg(a.score), 2) + 0.0 AS dwell,
  (SELECT count(*) FROM meta WHERE participant_id NOT IN (SELECT participant_id FROM a))::BIGINT AS lost FROM meta m JOIN a USING (participant_id) GROUP BY 1, 2""")
def joined_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Two cohorts split by membership and tagged again, ids repaired, joined to their dwell with what that loses."""
    people = roles.readers(spark, sf).select("participant_id", "L1", "score", "native")
    fixes = people.where("participant_id % 10 = 3").select("L1", F.col("participant_id").alias("old_id"), (-F.col("participant_id")).alias("new_id"))
    first, second = joins.by_membership(people.drop("native"), people.where("native"), "participant_id")
    both = joins.tagged_union({"first": first, "second": second})
    dwell = roles.words(spark, sf, numbered=False).where("paragraph <= 4").groupBy("participant_id").agg(F.sum("fp").alias("score"))
    _, lost = joins.inner_with_lost(both, dwell, ["participant_id"])
    rows = joins.repair_ids(joins.with_suffix(dwell, both, ["participant_id"]), fixes, ["L1"], "participant_id")
    out = rows.groupBy("cohort", "L1").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("participant_id") < 0).cast("long")).alias("repaired"), F.avg("score_meta").alias("balance"), F.avg("score").alias("dwell"))
    return rounded_all(out.crossJoin(F.broadcast(lost.where("side = 'left'").agg(F.count(F.lit(1)).alias("lost")))), 2, "balance", "dwell")


@query(W + """, t AS (SELECT * FROM (VALUES (0, 'a', 1.0), (1, 'a', 3.0), (2, 'a', 2.5), (0, 'b', 4.0), (1, 'b', 0.5), (3, 'b', 2.0)) v(k, c, d)), x AS (SELECT k, avg(d) AS distance FROM t GROUP BY k)
SELECT participant_id, L1, round(distance, 6) + 0.0 AS distance FROM meta LEFT JOIN x ON k = lang_no % 5""")
def language_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Readers with their language's composite distance; null without one."""
    people = roles.readers(spark, sf).select("participant_id", "L1", "lang_no")
    rows = [(f"i{k}", c, d) for k, c, d in ((0, "a", 1.0), (1, "a", 3.0), (2, "a", 2.5), (0, "b", 4.0), (1, "b", 0.5), (3, "b", 2.0))]
    table_ = spark.createDataFrame(rows, "iso string, component string, distance double")
    known = people.select("L1", "lang_no").distinct().where("lang_no % 5 < 4").collect()
    out = distances.by_language(people, table_, {r["L1"]: f"i{r['lang_no'] % 5}" for r in known}, "a+b")
    return rounded_all(out.select("participant_id", "L1", "distance"), 6, "distance")


@query("""
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) f FROM embeddings), b AS (SELECT f, v AS b FROM l WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
u AS (SELECT vec_id, l.f, CASE WHEN l.f % 2 = 0 THEN greatest(v, 0) WHEN v < 0 THEN NULL ELSE v END AS v FROM l)
SELECT vec_id, round(2 * acos(greatest(-1, least(1, sum(v * b) / sqrt(sum(v * v) * sum(b * b))))) / pi(), 5) + 0.0 AS distance FROM u JOIN (SELECT f, CASE WHEN f % 2 = 0 THEN greatest(b, 0) WHEN b < 0 THEN NULL ELSE b END AS b FROM b) USING (f) WHERE v IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING sum(v * v) * sum(b * b) > 0""")
def angular_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Angle to the first vector over components both know; even ones come from two sources of which one is 0."""
    e = table(spark, sf, "embeddings")
    long = e.select(F.col("vec_id").alias("iso"), F.posexplode("embedding").alias("at", "x")).select("iso", (F.col("at") + 1).alias("feature"), F.col("x").cast("double").alias("value"))
    merged = distances.merged_sources(long.unionByName(long.where("feature % 2 = 0").withColumn("value", F.lit(0.0))))
    first = e.agg(F.min("vec_id")).first()[0]
    out = distances.angular(merged, first).where("distance is not null")
    return rounded_all(out.select(F.col("iso").alias("vec_id"), "distance"), 5, "distance")


@query(W + """, p AS (SELECT participant_id, content_group g, L1 b FROM meta WHERE NOT native), s AS (SELECT DISTINCT g, b FROM p), t AS (SELECT g AS segment, 'ALL' AS pool, 'test' AS role, participant_id FROM p UNION ALL SELECT g, 'SEEN', 'test', participant_id FROM p UNION ALL SELECT g, 'UNSEEN', 'test', participant_id FROM p
  UNION ALL SELECT s.g, 'ALL', 'train', participant_id FROM p, (SELECT DISTINCT g FROM p) s UNION ALL SELECT g, 'SEEN', 'train', participant_id FROM p UNION ALL SELECT s.g, 'UNSEEN', 'train', participant_id FROM p JOIN (SELECT DISTINCT g FROM p) s ON s.g <> p.g)
SELECT pool, segment, role, count(*) AS people, min(participant_id) AS first FROM t GROUP BY 1, 2, 3""")
def pool_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Who trains and who is tested in each content group's segment, by pool."""
    people = roles.readers(spark, sf).where("not native").select("participant_id", "content_group")
    out = None
    for pool in ("ALL", "SEEN", "UNSEEN"):
        one = splits.pool_roles(people, "participant_id", "content_group", pool).withColumn("pool", F.lit(pool))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("pool", "segment", "role").agg(F.count(F.lit(1)).alias("people"), F.min("participant_id").alias("first"))


@query(_WIDE2 + """, a AS (SELECT participant_id, native, CASE WHEN participant_id % 4 = 0 THEN -1 ELSE score END AS t, CASE WHEN participant_id % 5 = 1 THEN NULL ELSE ff END AS x, participant_id % 3 AS fold FROM wide JOIN meta USING (participant_id)),
m AS (SELECT avg(t) FILTER (native AND t <> -1) AS mt FROM a), f AS (SELECT k.fold, avg(x) FILTER (NOT native) AS mx FROM (SELECT DISTINCT fold FROM a) k JOIN a ON a.fold <> k.fold GROUP BY 1)
SELECT participant_id, round(CASE WHEN native AND t = -1 THEN mt ELSE t END, 4) + 0.0 AS target, round(coalesce(x, mx), 6) + 0.0 AS x FROM a JOIN f USING (fold), m""")
def imputed(spark: SparkSession, sf: str) -> DataFrame:
    """Natives' missing targets by the natives' mean, gaps of a feature by the other folds' second-language readers."""
    rows = wide_rows(spark, sf).select("participant_id", "native", F.when(F.col("participant_id") % 4 == 0, -1.0).otherwise(F.col("score")).alias("target"), F.when(F.col("participant_id") % 5 != 1, F.col("ff")).alias("x"), (F.col("participant_id") % 3).alias("fold"))
    out = models.impute_by_fold(models.impute_native_targets(rows, "target", "native", 100.0).withColumn("second", ~F.col("native")), ["x"], "fold", "second")
    return rounded_all(rounded_all(out.select("participant_id", F.round("target", 4).alias("target"), "x"), 6, "x"), 6, "target")


@query(_SCORES + """, q AS (SELECT L1, lang_no, eye_score - (SELECT regr_intercept(eye_score, score) FROM ds) - (SELECT regr_slope(eye_score, score) FROM ds) * score AS residual, distance FROM ds)
SELECT L1, count(*) AS n, round(avg(residual), 6) + 0.0 AS mean_value, round(min(distance), 6) + 0.0 AS distance FROM q GROUP BY 1""")
def language_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Each language's mean residual beside its distance."""
    found = scores(spark, sf)
    known = with_distance(found.select("L1", "lang_no").distinct()).select("L1", "distance")
    out = debias.language_summary(debias.residuals(debias.prepared(found, known, "score", missing=-1e9), "eye_score", "score"), "residual")
    return rounded_all(out, 6, "mean_value", "distance")


@query(_SCORES + """, p AS (SELECT participant_id, eye_score AS a, score AS b FROM sc WHERE eye_score IS NOT NULL)
SELECT participant_id, 'g' || (participant_id % 3) || '_' || (participant_id % 2) AS content_group, 'g' || (participant_id % 3) AS batch, CASE WHEN abs(a) < 0.001 THEN 3 WHEN abs(a) < 0.01 THEN 2 WHEN abs(a) < 0.05 THEN 1 ELSE 0 END * sign(b)::INT AS signed,
  'p000000000007_w' || lpad(participant_id::VARCHAR, 12, '0') AS place, participant_id::INT AS i, 'l1_' || (participant_id % 3) || '_1' AS combo FROM p""")
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of results: signed stars, batches, sorting keys, parsed cell names, combinations."""
    df = scores(spark, sf).where("eye_score is not null").withColumn("p", F.abs("eye_score")).withColumn("zero", F.lit(0.0))
    df = df.withColumns({"content_group": F.concat(F.lit("g"), (F.col("participant_id") % 3).cast("string"), F.lit("_"), (F.col("participant_id") % 2).cast("string")), "cell": F.concat(F.lit("x_7_"), F.col("participant_id").cast("string")), "name": F.concat(F.lit("p7_w"), F.col("participant_id").cast("string")), "who": F.lit("l1_77"), "batch_no": F.col("participant_id") % 3, "preview": F.lit("1")})
    return df.select("participant_id", "content_group", scalars.batch_of("content_group").alias("batch"), scalars.signed_stars("p", "score", "zero").alias("signed"), scalars.natural_key("name").alias("place"), scalars.parsed_pair("cell")["i"].alias("i"), scalars.combo_key("who", "batch_no", "preview").alias("combo"))
