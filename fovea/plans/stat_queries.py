"""Evaluation, comparison and reliability over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea import sources
from fovea.functions import report
from fovea.operators import filters, joins, ranks, reliability, splits, stats
from fovea.operators.windows import average_rank
from fovea.plans import roles
from fovea.plans.registry import query, rounded_all
from fovea.plans.score_queries import _SCORES, _model_rows, scores
from fovea.sources import table
from fovea.sources.shared import keep

W = roles.SQL
# a reader's per-paragraph means as items
_CELLS = W + """, cell AS (SELECT participant_id AS who, paragraph AS item, avg(ff) AS value FROM words0 GROUP BY 1, 2)"""
_WIDE2 = W + """, wide AS (SELECT participant_id, avg(ff) ff, avg(fp) fp, avg(tf) tf, avg(rp) rp, avg(sk) sk, avg(rr) rr FROM words0 GROUP BY 1),
mr AS (SELECT * FROM wide JOIN meta USING (participant_id) WHERE NOT native)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's mean by paragraph; kept, so coefficients with several sums read the line items once."""
    w = roles.words(spark, sf, numbered=False)
    cells = reliability.one_per_cell(w.select(F.col("participant_id").alias("who"), F.col("paragraph").alias("item"), "ff"), "who", "item", "ff")
    return keep(cells.withColumnRenamed("value", "ff"))


@query(_SCORES + """ SELECT CASE WHEN grouping(L1) = 1 THEN 'All' ELSE L1 END AS "L1", count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(eye_score, score), 6) + 0.0 END AS pearson_r
FROM sc GROUP BY GROUPING SETS ((L1), ())""")
def pearson_eval_by_l1(spark: SparkSession, sf: str) -> DataFrame:
    df = scores(spark, sf).withColumn("cell", F.lit("cosine"))
    out = stats.with_total(df, ["cell"], "L1", [F.count(F.lit(1)).alias("n"), stats.pearson("eye_score", "score").alias("pearson_r")])
    return rounded_all(out.select("L1", "n", "pearson_r"), 6, "pearson_r")


@query(_SCORES + """, k AS (SELECT content_group, rank() OVER (PARTITION BY content_group ORDER BY eye_score) + (count(*) OVER (PARTITION BY content_group, eye_score) - 1) / 2.0 a,
  rank() OVER (PARTITION BY content_group ORDER BY score) + (count(*) OVER (PARTITION BY content_group, score) - 1) / 2.0 b FROM sc)
SELECT content_group, count(*) AS n, round(corr(a, b), 6) + 0.0 AS spearman_r FROM k GROUP BY 1""")
def spearman_avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(stats.spearman(scores(spark, sf), "eye_score", "score", ["content_group"]), 6, "spearman_r")


@query("""
SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_orderpriority) - 1) / 2.0::DOUBLE AS place,
  row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""")
def overall_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Over all orders: the rank of the priority, whose ties are a fifth of the rows, and the place by price."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = ranks.positions(ranks.average_ranks(orders, "o_orderpriority", "place"), F.desc("o_totalprice"), "o_orderkey")
    return out.select("o_orderkey", "place", "position")


@query(W + """, k AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) + 0.0 AS spearman_r FROM k""")
def spearman_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Over all line items at once; the quantity has fifty values."""
    return rounded_all(stats.spearman(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"), 6, "spearman_r")


@query("""
SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE AS place FROM orders""")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", average_rank("o_orderpriority", ["o_custkey"]).alias("place"))


_LONG = _WIDE2 + """, lg AS (UNPIVOT (SELECT participant_id, region, ff, sk, rr FROM mr) ON ff, sk, rr INTO NAME name VALUE value),
pq AS (SELECT a.region, a.name a, b.name b, a.value x, b.value y FROM lg a JOIN lg b ON a.participant_id = b.participant_id WHERE a.name <= b.name)"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return _model_rows(spark, sf).select("participant_id", "region", "ff", "sk", "rr").unpivot(["participant_id", "region"], ["ff", "sk", "rr"], "name", "value")


@query(_LONG + " SELECT region, a, b, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson_r FROM pq GROUP BY 1, 2, 3")
def score_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(stats.matrix(_long(spark, sf), "participant_id", "name", "value", ["region"]).drop("mean_abs_diff"), 6, "pearson_r")


@query(_LONG + " SELECT a, b, count(*) AS n, round(avg(abs(x - y)), 6) + 0.0 AS mean_abs_diff FROM pq GROUP BY 1, 2")
def mean_abs_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(stats.matrix(_long(spark, sf), "participant_id", "name", "value").drop("pearson_r"), 6, "mean_abs_diff")


_PAIRS = _WIDE2 + """, c AS (SELECT region, count(*) n, corr(ff, score) ra, corr(tf, score) rb, corr(ff, tf) rab FROM mr GROUP BY 1)"""


@query(_PAIRS + """, p AS (SELECT *, (rab * (1 - ra * ra - rb * rb) - ra * rb * (1 - ra * ra - rb * rb - rab * rab) / 2) / ((1 - ra * ra) * (1 - rb * rb)) q FROM c)
SELECT region, n, round((atanh(ra) - atanh(rb)) * sqrt(n - 3) / sqrt(2 - 2 * q), 6) + 0.0 AS steiger_z FROM p""")
def steiger(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.compared(_model_rows(spark, sf), ["region"], "score", "ff", "tf")
    return rounded_all(out.select("region", "n", "steiger_z"), 6, "steiger_z")


@query(_PAIRS + """, s AS (SELECT *, (ra * ra + rb * rb) / 2 q FROM c), f AS (SELECT *, least(1.0, (1 - rab) / (2 * (1 - q))) f FROM s), h AS (SELECT *, (1 - f * q) / (1 - q) h FROM f)
SELECT region, n, round((atanh(ra) - atanh(rb)) * sqrt((n - 3) / (2 * (1 - rab) * h)), 6) + 0.0 AS meng_z FROM h""")
def meng(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.compared(_model_rows(spark, sf), ["region"], "score", "ff", "tf")
    return rounded_all(out.select("region", "n", "meng_z"), 6, "meng_z")


@query(_WIDE2 + """, lg AS (UNPIVOT (SELECT participant_id, region, score, ff, tf, sk FROM mr) ON ff, tf, sk INTO NAME name VALUE value),
pq AS (SELECT a.region, a.score, a.name a, b.name b, a.value x, b.value y FROM lg a JOIN lg b ON a.participant_id = b.participant_id
  WHERE CASE WHEN a.name = 'ff' THEN 'zz' ELSE a.name END < CASE WHEN b.name = 'ff' THEN 'zz' ELSE b.name END),
c AS (SELECT region, a, b, count(*) n, corr(x, score) ra, corr(y, score) rb, corr(x, y) rab FROM pq GROUP BY 1, 2, 3),
s AS (SELECT *, (rab * (1 - ra * ra - rb * rb) - ra * rb * (1 - ra * ra - rb * rb - rab * rab) / 2) / ((1 - ra * ra) * (1 - rb * rb)) q, (ra * ra + rb * rb) / 2 m FROM c),
f AS (SELECT *, least(1.0, (1 - rab) / (2 * (1 - m))) f FROM s)
SELECT region, a, b, n, round(ra, 6) + 0.0 AS r_a, round(rb, 6) + 0.0 AS r_b, round(rab, 6) + 0.0 AS r_ab, round((atanh(ra) - atanh(rb)) * sqrt(n - 3) / sqrt(2 - 2 * q), 5) + 0.0 AS steiger_z,
  round((atanh(ra) - atanh(rb)) * sqrt((n - 3) / (2 * (1 - rab) * (1 - f * m) / (1 - m))), 5) + 0.0 AS meng_z FROM f""")
def pairwise_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every two features as predictors of the score, the baseline ff on side b, with both tests."""
    long = _model_rows(spark, sf).select("participant_id", "region", "score", "ff", "tf", "sk").unpivot(["participant_id", "region", "score"], ["ff", "tf", "sk"], "name", "value")
    pairs = joins.unordered_pairs(long, ["participant_id", "region", "score"], "name", "value", last="ff")
    out = stats.compared(pairs, ["region", "a", "b"], "score").drop("steiger_p", "meng_p")
    return rounded_all(rounded_all(out, 6, "r_a", "r_b", "r_ab"), 5, "steiger_z", "meng_z")


@query(_LONG + """ SELECT CASE WHEN a = 'ff' THEN b ELSE a END AS a, CASE WHEN a = 'ff' THEN 'ff' ELSE b END AS b, count(*) AS n FROM pq WHERE a <> b GROUP BY 1, 2""")
def oriented_pairs(spark: SparkSession, sf: str) -> DataFrame:
    long = _model_rows(spark, sf).select("participant_id", "ff", "sk", "rr").unpivot("participant_id", ["ff", "sk", "rr"], "name", "value").where("value is not null")
    return joins.unordered_pairs(long, ["participant_id"], "name", "value", last="ff").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(_WIDE2 + """, p AS (SELECT region, score t, ff * 100 p FROM mr)
SELECT region, count(*) AS n, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) + 0.0 AS r2, round(sqrt(avg((t - p) * (t - p))), 4) + 0.0 AS rmse, round(avg(abs(t - p)), 5) + 0.0 AS mae,
  round(corr(t, p), 6) + 0.0 AS pearson_r FROM p GROUP BY 1""")
def metrics_r2_rmse_mae(spark: SparkSession, sf: str) -> DataFrame:
    df = _model_rows(spark, sf).select("region", F.col("score").alias("t"), (F.col("ff") * 100).alias("p"))
    out = df.groupBy("region").agg(*stats.error_metrics("t", "p"))
    return rounded_all(out.withColumns({"rmse": F.round("rmse", 4) + F.lit(0.0), "mae": F.round("mae", 5)}), 6, "r2", "pearson_r")


@query(_CELLS + """, i AS (SELECT item, var_samp(value) v FROM cell GROUP BY 1), t AS (SELECT who, sum(value) t FROM cell GROUP BY 1)
SELECT (SELECT count(*) FROM i) AS items, (SELECT count(*) FROM t) AS people, round((SELECT count(*) FROM i) / ((SELECT count(*) FROM i) - 1.0) * (1 - (SELECT sum(v) FROM i) / (SELECT var_samp(t) FROM t)), 6) + 0.0 AS alpha""")
def alpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.cronbach_alpha(_cells(spark, sf), "who", "item", "ff"), 6, "alpha")


@query(_CELLS + """, g AS (SELECT cell.*, item % 2 AS stratum FROM cell), i AS (SELECT stratum, item, var_samp(value) v FROM g GROUP BY 1, 2), ii AS (SELECT stratum, count(*) k, sum(v) v FROM i GROUP BY 1),
t AS (SELECT stratum, who, sum(value) t FROM g GROUP BY 1, 2), tt AS (SELECT stratum, var_samp(t) v FROM t GROUP BY 1), a AS (SELECT stratum, k / (k - 1.0) * (1 - ii.v / tt.v) a, tt.v FROM ii JOIN tt USING (stratum)),
w AS (SELECT who, sum(value) t FROM g GROUP BY 1)
SELECT round(1 - (SELECT sum(v * (1 - a)) FROM a) / (SELECT var_samp(t) FROM w), 6) + 0.0 AS stratified_alpha""")
def stratified_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.stratified_alpha(_cells(spark, sf).withColumn("stratum", F.col("item") % 2), "who", "item", "ff", "stratum"), 6, "stratified_alpha")


@query(_CELLS + """, c AS (SELECT * FROM cell WHERE who IN (SELECT who FROM cell GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT item) FROM cell))),
p AS (SELECT who, sum(value) s, count(*) k FROM c GROUP BY 1), i AS (SELECT item, sum(value) s, count(*) n FROM c GROUP BY 1), g AS (SELECT sum(value) s, sum(value * value) q, count(*) c FROM c),
b AS (SELECT (SELECT count(*) FROM i) k, (SELECT count(*) FROM p) n, (SELECT sum(s * s / k) FROM p) a, (SELECT sum(s * s / n) FROM i) d, q, s * s / c z FROM g),
m AS (SELECT k, n, (a - z) / (n - 1) r, (d - z) / (k - 1) c, (q - a) / (n * (k - 1)) w, (q - a - d + z) / ((n - 1) * (k - 1)) e FROM b)
SELECT k AS items, n AS people, round((r - w) / (r + (k - 1) * w), 6) AS icc1, round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc2, round((r - e) / (r + (k - 1) * e), 6) AS icc3,
  round((r - w) / r, 6) AS icc1k, round((r - e) / (r + (c - e) / n), 6) AS icc2k, round((r - e) / r, 6) AS icc3k FROM m""")
def icc_anova(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.icc(_cells(spark, sf), "who", "item", "ff"), 6, "icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")


@query(_CELLS + """, o AS (SELECT who, count(*) c, avg(value) m, var_pop(value) * count(*) q FROM cell GROUP BY 1),
t AS (SELECT count(*) g, sum(c) n, sum(c * c) cc, sum(q) w, sum(c * m * m) - sum(c * m) * sum(c * m) / sum(c) b FROM o),
v AS (SELECT g, b / (g - 1) b, w / (n - g) w, (n - cc / n) / (g - 1) k FROM t)
SELECT g AS people, round((b - w) / (b + (k - 1) * w), 6) + 0.0 AS icc1, round((b - w) / b, 6) + 0.0 AS icc1k FROM v""")
def icc_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(reliability.icc_all_readers(_cells(spark, sf), "who", "item", "ff"), 6, "icc1", "icc1k")


@query()
def icc_reml(spark: SparkSession, sf: str) -> DataFrame:
    """By nation: each group is a few hundred readers by seven paragraphs."""
    people = roles.readers(spark, sf).select(F.col("participant_id").alias("who"), "L1")
    return reliability.icc_crossed_reml(_cells(spark, sf).join(people, "who"), "who", "item", "ff", ["L1"])


@query(_CELLS + """, i AS (SELECT item, var_samp(value) v FROM cell GROUP BY 1), t AS (SELECT who, sum(value) t, avg(value) m FROM cell GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM i) / ((SELECT count(*) FROM i) - 1.0) * (1 - (SELECT sum(v) FROM i) / (SELECT var_samp(t) FROM t)) a, (SELECT stddev_samp(m) FROM t) s)
SELECT round(s, 6) AS sd, round(s * sqrt(greatest(0, 1 - a)), 6) AS sem FROM a""")
def sem(spark: SparkSession, sf: str) -> DataFrame:
    cells = reliability.one_per_cell(_cells(spark, sf), "who", "item", "ff")
    both = reliability.person_sd(cells, "who", "value").crossJoin(F.broadcast(reliability.cronbach_alpha(cells, "who", "item", "value")))
    return both.select(F.round("sd", 6).alias("sd"), F.round(reliability.standard_error(F.col("sd"), F.col("alpha")), 6).alias("sem"))


@query(_CELLS + """, s AS (SELECT who, avg(value) FILTER (item % 2 = 0) x, avg(value) FILTER (item % 2 = 1) y FROM cell GROUP BY 1), r AS (SELECT corr(x, y) r FROM s WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT 1::BIGINT AS draws, round(r, 6) + 0.0 AS r_mean, 0.0::DOUBLE AS r_sd, round(2 * r / (1 + r), 6) + 0.0 AS reliability FROM r""")
def split_half_parity(spark: SparkSession, sf: str) -> DataFrame:
    halves = spark.createDataFrame([(d, i, h) for d, h, i in splits.parity_halves(range(1, 8))], "draw int, item int, half int")
    return rounded_all(reliability.split_half(_cells(spark, sf), halves, "who", "item", "ff"), 6, "r_mean", "r_sd", "reliability")


_HALVES = splits.random_item_halves(list(range(1, 8)), None, 20)


@query(_CELLS + f""", hv(draw, item, half) AS (VALUES {", ".join(map(str, _HALVES))}),
s AS (SELECT draw, who, avg(value) FILTER (half = 0) x, avg(value) FILTER (half = 1) y FROM cell JOIN hv USING (item) GROUP BY 1, 2), r AS (SELECT draw, corr(x, y) r FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT count(r) AS draws, round(avg(r), 6) + 0.0 AS r_mean, round(stddev_pop(r), 6) + 0.0 AS r_sd, round(avg(2 * r / (1 + r)), 6) + 0.0 AS reliability FROM r""")
def split_half_random(spark: SparkSession, sf: str) -> DataFrame:
    halves = spark.createDataFrame(_HALVES, "draw int, item int, half int")
    return rounded_all(reliability.split_half(_cells(spark, sf), halves, "who", "item", "ff"), 6, "r_mean", "r_sd", "reliability")


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders
WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') OR o_totalprice > 1000""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = o.where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_totalprice > 1000").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return sources.upsert(o, new, {"o_orderstatus": ["O"], "o_orderpriority": ["1-URGENT"]}).drop("o_orderpriority")


@query(_WIDE2 + """, q AS (SELECT avg(ff) a, stddev_samp(ff) b, avg(score) c, stddev_samp(score) d, avg(rr) e, stddev_samp(rr) f FROM mr),
z AS (SELECT participant_id, ((ff - a) / b + (score - c) / d + coalesce((rr - e) / f, 0)) / (2 + (rr IS NOT NULL)::INTEGER) z FROM mr, q), r AS (SELECT min(z) lo, max(z) hi FROM z)
SELECT participant_id, round_even(1 + 99 * (z - lo) / (hi - lo), 0) AS composite FROM z, r""")
def composite_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return stats.composite(_model_rows(spark, sf).select("participant_id", "ff", "score", "rr"), ["ff", "score", "rr"]).select("participant_id", "composite")


@query()
def first_component(spark: SparkSession, sf: str) -> DataFrame:
    return stats.first_component(_model_rows(spark, sf), "participant_id", ["ff", "fp", "sk", "rr"])


@query()
def bootstrap_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap(_model_rows(spark, sf), ["region"], "ff", "score", who="participant_id", mae=True)


@query()
def bootstrap_pair_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap_difference(_model_rows(spark, sf), ["region"], "score", "ff", "tf", who="participant_id", mae=True)


@query(W + """, p AS (SELECT participant_id, paragraph, sum(ff) s, count(*) c FROM words0 GROUP BY 1, 2), k AS (SELECT *, sum(s) OVER w / sum(c) OVER w m, row_number() OVER w AS upto FROM p WINDOW w AS (PARTITION BY participant_id ORDER BY paragraph))
SELECT upto::INTEGER AS upto, count(*) AS n, round(corr(m, score), 6) + 0.0 AS pearson_r FROM k JOIN meta USING (participant_id) WHERE NOT native GROUP BY 1""")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by the number of first paragraphs read: running sums, one pass for all points."""
    from pyspark.sql import Window

    p = roles.words(spark, sf, numbered=False).groupBy("participant_id", "paragraph").agg(F.sum("ff").alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("participant_id").orderBy("paragraph")
    k = p.withColumns({"m": F.sum("s").over(w) / F.sum("c").over(w), "upto": F.row_number().over(w)})
    out = stats.correlations(k.join(roles.readers(spark, sf).where("not native"), "participant_id"), "m", "score", ["upto"], with_p=False)
    return rounded_all(out, 6, "pearson_r")


@query(W + """, p AS (SELECT participant_id, paragraph, avg(ff) m FROM words0 GROUP BY 1, 2), f AS (SELECT participant_id, avg(ff) f FROM words0 GROUP BY 1)
SELECT paragraph, round(avg(m - f), 6) + 0.0 AS bias FROM p JOIN f USING (participant_id) GROUP BY 1""")
def window_bias(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False)
    item, full = w.groupBy("participant_id", "paragraph").agg(F.avg("ff").alias("m")), w.groupBy("participant_id").agg(F.avg("ff").alias("f"))
    return rounded_all(item.join(full, "participant_id").groupBy("paragraph").agg(F.avg(F.col("m") - F.col("f")).alias("bias")), 6, "bias")


@query(_WIDE2 + """ SELECT participant_id FROM mr WHERE score <> -1 AND (ff IS NOT NULL OR rr IS NOT NULL)""")
def valid_targets(spark: SparkSession, sf: str) -> DataFrame:
    return filters.valid_targets(_model_rows(spark, sf), "score", ["ff", "rr"]).select("participant_id")


@query("""
WITH s AS (SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 2) m FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, m = max(m) OVER (PARTITION BY c_mktsegment) AS m_best FROM s""")
def best_in_block(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return report.best_marked(s, ["c_mktsegment"], {"m": "max"}, 2).select("c_mktsegment", "c_nationkey", "m_best")


@query("""
SELECT c_custkey, split_part(p, '/', 1) AS dataset, split_part(p, '/', 2) AS preview, regexp_replace(split_part(p, '/', 3) || '/' || split_part(p, '/', 4), '(?:^|/)inner_[^/]+$', '') AS version,
  nullif(regexp_extract(split_part(p, '/', 4), '^inner_(.+)$', 1), '') AS "inner" FROM (SELECT c_custkey, c_mktsegment || '/All/' || 'v' || c_nationkey || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'inner_kfold' ELSE 'p1' END AS p FROM customer)""")
def result_paths(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 2 == 0, "inner_kfold").otherwise("p1")
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("/All/v"), "c_nationkey", F.lit("/"), tail, F.lit("/X_Y.csv")).alias("path"))
    parts = sources.path_parts("path", ["dataset", "preview", "a", "b"])
    c = c.select("c_custkey", parts["dataset"].alias("dataset"), parts["preview"].alias("preview"), F.concat_ws("/", parts["a"], parts["b"]).alias("v"))
    split = sources.version_and_inner("v")
    return c.select("c_custkey", "dataset", "preview", split["version"].alias("version"), split["inner"].alias("inner"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def scan_filter_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query(_WIDE2 + """ SELECT region, count(*) AS n, count(*) FILTER (feature IS NOT NULL) AS cells FROM (SELECT region, unnest([ff, sk, rr]) feature FROM mr) GROUP BY 1""")
def feature_coverage(spark: SparkSession, sf: str) -> DataFrame:
    long = _long(spark, sf)
    return long.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("cells"))
