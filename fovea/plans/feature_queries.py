"""Cleaning, filters, windows and features over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fovea import sources
from fovea.functions import scalars as S
from fovea.operators import features, filters, joins, windows
from fovea.plans import roles
from fovea.plans.registry import least_squares, query, rounded, rounded_all
from fovea.sources import table

W = roles.SQL


@query(W + """, t AS (SELECT participant_id, trial, count(*) n, min(1000.0 * ff) ms FROM words0 GROUP BY ALL)
SELECT participant_id, round(sum(n) / (sum(ms) / 60000.0), 6) + 0.0 AS reading_speed FROM t GROUP BY 1""")
def reading_speed(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False).withColumn("paragraph_rt", 1000.0 * F.col("ff"))
    return rounded_all(features.reading_speed(w, ["participant_id"], "trial", "paragraph_rt"), 6, "reading_speed")


@query(W + """
SELECT participant_id, round(avg(ff) + 3e-6, 4) + 0.0 ff, round(avg(fp) + 3e-6, 4) + 0.0 fp, round(avg(tf) + 3e-6, 4) + 0.0 tf, round(avg(rp) + 3e-6, 4) + 0.0 rp,
  round(avg(sk), 6) + 0.0 sk, round(avg(rr), 6) + 0.0 rr FROM words0 GROUP BY 1""")
def fixation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = features.metric_means(roles.words(spark, sf, numbered=False), ["participant_id"], roles.METRICS)
    return rounded_all(rounded_all(df, 4, "ff", "fp", "tf", "rp"), 6, "sk", "rr")


@query(W + """
SELECT participant_id, ptb_pos, round(avg(ff) + 3e-6, 4) + 0.0 ff, round(avg(fp) + 3e-6, 4) + 0.0 fp, round(avg(sk), 6) + 0.0 sk, round(avg(rr), 6) + 0.0 rr
FROM words0 WHERE ptb_pos IN ('A', 'N', 'R') GROUP BY 1, 2""")
def s_clusters(spark: SparkSession, sf: str) -> DataFrame:
    df = features.clusters(roles.words(spark, sf, numbered=False), ["participant_id"], "ptb_pos", roles.TAGS, {m: m for m in ("ff", "fp", "sk", "rr")})
    return rounded_all(rounded_all(df, 4, "ff", "fp"), 6, "sk", "rr")


@query(W + """, a AS (SELECT participant_id, ptb_pos, avg(ff) ff, avg(sk) sk FROM words0 WHERE ptb_pos IN ('A', 'N') GROUP BY 1, 2),
b AS (SELECT participant_id, avg(ff) ff, avg(sk) sk FROM words0 WHERE ptb_pos IN ('A', 'N') GROUP BY 1)
SELECT a.participant_id, ptb_pos, round(a.ff / nullif(b.ff, 0), 6) + 0.0 ff, round(a.sk / nullif(b.sk, 0), 6) + 0.0 sk FROM a JOIN b USING (participant_id)""")
def s_clusters_norm(spark: SparkSession, sf: str) -> DataFrame:
    df = features.clusters(roles.words(spark, sf, numbered=False), ["participant_id"], "ptb_pos", ("A", "N"), {"ff": "ff", "sk": "sk"}, normalized=True)
    return rounded_all(df, 6, "ff", "sk")


@query(W + """
SELECT participant_id, round(avg(ff) FILTER (ptb_pos = 'A') + 3e-6, 4) + 0.0 AS "A_ff", round(avg(rr) FILTER (ptb_pos = 'A'), 6) + 0.0 AS "A_rr",
  round(avg(ff) FILTER (ptb_pos = 'R') + 3e-6, 4) + 0.0 AS "R_ff", round(avg(rr) FILTER (ptb_pos = 'R'), 6) + 0.0 AS "R_rr"
FROM words0 WHERE ptb_pos IN ('A', 'R') GROUP BY 1""")
def s_clusters_wide(spark: SparkSession, sf: str) -> DataFrame:
    long = features.clusters(roles.words(spark, sf, numbered=False), ["participant_id"], "ptb_pos", ("A", "R"), {"ff": "ff", "rr": "rr"})
    wide = features.wide_clusters(long, ["participant_id"], "ptb_pos", ("A", "R"), ["ff", "rr"])
    return rounded_all(rounded_all(wide, 4, "A_ff", "R_ff"), 6, "A_rr", "R_rr")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN (l_linenumber >= 3)::INTEGER::DOUBLE END AS ia_rr,
  l_returnflag IN ('NOUN', 'VERB') AS is_content_word, round(l_discount / nullif(l_tax, 0), 6) + 0.0 AS regression_rate FROM lineitem""")
def regression_indicator(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumns({"prog": F.when(F.col("l_linestatus") == "O", 1).otherwise(0), "out": F.when(F.col("l_linenumber") >= 3, 1).otherwise(0)})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.first_pass_regression("prog", "out").alias("ia_rr"), S.is_content_word("l_returnflag").alias("is_content_word"), rounded(S.rate("l_discount", "l_tax")).alias("regression_rate"))


@query("""
SELECT event_id, COALESCE(TRY_CAST(TRY_CAST(x AS DOUBLE) AS BIGINT), 0) AS as_int, TRY_CAST(x AS DOUBLE) AS as_float FROM (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '.' WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100)::VARCHAR END AS x FROM events)""")
def dirty_casts(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, ".").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise((F.col("event_id") % 100).cast("string"))
    df = table(spark, sf, "events").select("event_id", x.alias("x"))
    return df.select("event_id", S.dirty_int("x").alias("as_int"), S.dirty_float("x").alias("as_float"))


@query("""
SELECT c_custkey, c_nationkey::VARCHAR || '_' || c_mktsegment AS key, rtrim(c_name || '-–', '-‐‑‒–—') AS label,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Buildings' ELSE c_mktsegment END AS name, round(c_nationkey + (c_custkey % 12) / 12.0, 6) AS years,
  CASE WHEN c_acctbal < 0.001 THEN '***' WHEN c_acctbal < 0.01 THEN '**' WHEN c_acctbal < 0.05 THEN '*' ELSE 'ns' END AS stars, split_part(c_name, '#', 1) AS batch,
  greatest(0.0, least(100.0, c_acctbal)) AS clipped, CASE WHEN c_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS half FROM customer""")
def row_scalars(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumns({"dashed": F.concat("c_name", F.lit("-–")), "months": F.col("c_custkey") % 12})
    return c.select(
        "c_custkey", S.composite_key("c_nationkey", "c_mktsegment").alias("key"), S.strip_dashes("dashed").alias("label"), S.mapped("c_mktsegment", {"BUILDING": "Buildings"}).alias("name"),
        F.round(S.years_and_months("c_nationkey", "months"), 6).alias("years"), S.stars("c_acctbal").alias("stars"), F.substring_index("c_name", "#", 1).alias("batch"), S.clipped("c_acctbal").alias("clipped"), S.half_of("c_custkey").alias("half"),
    )


@query(W + """
SELECT trial, word, coalesce(lag(fp) OVER w, 1000000) > fp AS start_of_line, coalesce(lead(fp) OVER w, -1) < fp AS end_of_line
FROM words WINDOW w AS (PARTITION BY trial ORDER BY word)""")
def line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return windows.line_flags(roles.words(spark, sf), ["trial"], ["word"], "fp").select("trial", "word", "start_of_line", "end_of_line")


@query(W + """
SELECT trial, word, line - min(line) OVER w AS shifted, max(line) OVER w - min(line) OVER w AS max_index, round(sum(ff) OVER w + 3e-6, 4) AS total_dwell
FROM words WINDOW w AS (PARTITION BY trial)""")
def span_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = windows.span_metrics(roles.words(spark, sf), ["trial"], "line", "ff")
    return df.select("trial", "word", F.col("line").alias("shifted"), "max_index", rounded("total_dwell", 4).alias("total_dwell"))


@query(W + """
SELECT trial, word, round((word - min(word) OVER w) / nullif(max(word) OVER w - min(word) OVER w, 0)::DOUBLE, 6) AS normalized_id,
  round(ff / nullif(sum(ff) OVER w, 0), 6) AS share FROM words WINDOW w AS (PARTITION BY trial)""")
def normalized_id(spark: SparkSession, sf: str) -> DataFrame:
    df = windows.normalized_index(roles.words(spark, sf), ["trial"], "word", "normalized_id").withColumn("share", windows.share_of_total("ff", ["trial"]))
    return rounded_all(df.select("trial", "word", "normalized_id", "share"), 6, "normalized_id", "share")


@query(W + """
SELECT participant_id, event_id, lead(word) OVER w AS next_ia, coalesce(lead(word) OVER w < word, false) AS is_reg, coalesce(lead(word) OVER w > word, false) AS is_progressive
FROM fix WINDOW w AS (PARTITION BY participant_id, paragraph ORDER BY ts, event_id)""")
def saccades(spark: SparkSession, sf: str) -> DataFrame:
    df = windows.next_fixation(roles.fixations(spark, sf), ["participant_id", "paragraph"], ["ts", "event_id"], "word")
    return df.select("participant_id", "event_id", "next_ia", S.moves_back("word", "next_ia").alias("is_reg"), S.moves_on("word", "next_ia").alias("is_progressive"))


@query(W + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY participant_id ORDER BY paragraph) k FROM words0)
SELECT participant_id, count(*) AS n, round(avg(ff) + 3e-6, 4) AS ff FROM r WHERE k <= 3 GROUP BY 1""")
def first_n_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    w = filters.first_n(roles.words(spark, sf, numbered=False), "participant_id", ["paragraph"], 3)
    return w.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("ff"), 4).alias("ff"))


@query(W + """, f AS (SELECT participant_id FROM words0 GROUP BY 1 HAVING count(DISTINCT paragraph) = 7)
SELECT participant_id, count(*) AS n FROM words0 WHERE participant_id IN (SELECT participant_id FROM f) GROUP BY 1""")
def full_reading_filter(spark: SparkSession, sf: str) -> DataFrame:
    w = filters.full_readers(roles.words(spark, sf, numbered=False), "participant_id", ["paragraph"], 7)
    return w.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))


@query(W + """, d AS (SELECT DISTINCT participant_id, paragraph FROM words0),
e AS (SELECT *, max(paragraph) OVER (PARTITION BY participant_id) m FROM d),
s AS (SELECT participant_id, paragraph, unnest(generate_series(greatest(paragraph - 2, 1), least(paragraph, greatest(m - 2, 1)))) st FROM e),
k AS (SELECT participant_id, paragraph, dense_rank() OVER (PARTITION BY participant_id ORDER BY st) - 1 AS window_index FROM s)
SELECT k.participant_id, k.window_index::INTEGER AS window_index, count(*) AS n, round(avg(ff) + 3e-6, 4) AS ff
FROM k JOIN words0 w ON k.participant_id = w.participant_id AND k.paragraph = w.paragraph GROUP BY 1, 2""")
def moving_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Means per window from sums per paragraph: rows are not multiplied by the window size."""
    w = roles.words(spark, sf, numbered=False).groupBy("participant_id", "paragraph").agg(F.count(F.lit(1)).alias("c"), F.sum("ff").alias("s"))
    placed = windows.id_windows(w, "participant_id", "paragraph", 3)
    return placed.groupBy("participant_id", F.col("window_index").cast("int").alias("window_index")).agg(F.sum("c").alias("n"), rounded(F.sum("s") / F.sum("c"), 4).alias("ff"))


@query(W + """, d AS (SELECT DISTINCT participant_id, paragraph FROM words0),
e AS (SELECT *, dense_rank() OVER (PARTITION BY participant_id ORDER BY paragraph) k FROM d),
m AS (SELECT *, greatest(max(k) OVER (PARTITION BY participant_id) - 3, 0) l FROM e)
SELECT participant_id, paragraph, unnest(generate_series(greatest(k - 3, 0), least(k - 1, l)))::INTEGER AS window_index FROM m""")
def positional_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False).select("participant_id", "paragraph").distinct()
    return windows.positional_windows(w, "participant_id", ["paragraph"], 3).withColumn("window_index", F.col("window_index").cast("int"))


@query(W + """
SELECT participant_id, paragraph, count(*) AS n, round(avg(ff) + 3e-6, 4) AS ff, round(avg(rr), 6) AS rr FROM words0 GROUP BY 1, 2""")
def per_item_metrics(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False)
    df = w.groupBy("participant_id", "paragraph").agg(F.count(F.lit(1)).alias("n"), F.avg("ff").alias("ff"), F.avg("rr").alias("rr"))
    return rounded_all(rounded_all(df, 4, "ff"), 6, "rr")


_TRANSITIONS = W + """, nx AS (SELECT *, lead(word) OVER (PARTITION BY participant_id, paragraph ORDER BY ts, event_id) nxt FROM fix),
tr AS (SELECT participant_id, paragraph, word i, nxt j, count(*)::DOUBLE AS value FROM nx WHERE nxt IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def _transitions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = windows.next_fixation(roles.fixations(spark, sf), ["participant_id", "paragraph"], ["ts", "event_id"], "word")
    return f, features.transitions(f, ["participant_id"], "paragraph", "word", "next_ia")


@query(_TRANSITIONS + " SELECT * FROM tr")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return _transitions(spark, sf)[1]


@query(_TRANSITIONS + """, dom AS (SELECT DISTINCT paragraph, i, j FROM tr), rd AS (SELECT DISTINCT participant_id, paragraph FROM fix)
SELECT rd.participant_id, rd.paragraph, dom.i, dom.j, coalesce(tr.value, 0) AS value FROM rd JOIN dom ON rd.paragraph = dom.paragraph
LEFT JOIN tr ON tr.participant_id = rd.participant_id AND tr.paragraph = rd.paragraph AND tr.i = dom.i AND tr.j = dom.j""")
def transitions_domain_fill(spark: SparkSession, sf: str) -> DataFrame:
    f, t = _transitions(spark, sf)
    return features.zero_filled(t, f, ["participant_id"], "paragraph", ["i", "j"]).select("participant_id", "paragraph", "i", "j", "value")


@query(W + """, l AS (SELECT participant_id, paragraph, line AS ia, unnest(['fp', 'tf']) metric, unnest([fp, tf]) v FROM words0)
SELECT participant_id, paragraph, ia, metric, round(avg(v) + 3e-6, 4) AS value FROM l GROUP BY 1, 2, 3, 4""")
def wfc(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False).withColumnRenamed("line", "ia")
    return rounded_all(features.word_dwell(w, ["participant_id"], "paragraph", "ia", {"fp": "fp", "tf": "tf"}), 4, "value")


@query("""
SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS labels, list_sort(list(DISTINCT l_returnflag))[1] AS first_sample
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1""")
def alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    df = features.misaligned(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")
    return df.select("l_orderkey", "l_linenumber", "labels", F.col("samples")[0].alias("first_sample"))


@query(W + """, a AS (SELECT participant_id, universal_pos AS batch, paragraph AS article, min(ptb_pos) lvl FROM words0 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY participant_id, batch ORDER BY article) k FROM a)
SELECT participant_id, batch, batch || '_' || lvl AS content_group FROM b WHERE k = 2""")
def content_group(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False).withColumnsRenamed({"universal_pos": "batch", "paragraph": "article"})
    return features.content_group(w, "participant_id", "batch", "article", "ptb_pos")


@query(W + """, f AS (SELECT *, row_number() OVER (PARTITION BY participant_id, paragraph ORDER BY ts, event_id) k FROM fix),
s AS (SELECT participant_id, paragraph, word, min(k) k0 FROM f GROUP BY 1, 2, 3),
e AS (SELECT s.participant_id, s.paragraph, s.word, s.k0, coalesce(min(g.k) FILTER (g.k > s.k0 AND g.word > s.word), 1000000000) k1
  FROM s JOIN f g ON g.participant_id = s.participant_id AND g.paragraph = s.paragraph GROUP BY 1, 2, 3, 4)
SELECT e.participant_id, e.paragraph, e.word, round(sum(g.duration) + 3e-6, 4) AS go_past
FROM e JOIN f g ON g.participant_id = e.participant_id AND g.paragraph = e.paragraph AND g.k >= e.k0 AND g.k < e.k1 GROUP BY 1, 2, 3""")
def go_past(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_all(windows.go_past(roles.fixations(spark, sf), ["participant_id", "paragraph"], ["ts", "event_id"], "word", "duration"), 4, "go_past")


@query(W + """
SELECT user_id AS participant_id, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM words0 w WHERE w.participant_id = user_id AND w.paragraph = 2) GROUP BY 1""")
def coverage_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf, numbered=False).where("paragraph = 2")
    e = table(spark, sf, "events").withColumnRenamed("user_id", "participant_id")
    return filters.only_read(e, w, ["participant_id"]).groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT p_brand, p_name, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1)
SELECT p.p_partkey, p.p_brand, s.p_name AS text_name, s.p_size AS text_size FROM part p LEFT JOIN s USING (p_brand)""")
def many_to_one_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    text = joins.first_of_key(p.select("p_brand", "p_name", "p_partkey", "p_size"), ["p_brand"], ["p_size", "p_partkey"])
    text = text.select("p_brand", F.col("p_name").alias("text_name"), F.col("p_size").alias("text_size"))
    return joins.many_to_one(p.select("p_partkey", "p_brand"), text, ["p_brand"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def metadata_override(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    other = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 2.0).alias("c_acctbal"))
    return joins.override(c, other, ["c_custkey"], ["c_acctbal"])


@query(W + """, k AS (SELECT participant_id, paragraph, ptb_pos, word - sum((ptb_pos = 'R')::INTEGER) OVER (PARTITION BY participant_id, paragraph ORDER BY word) AS word FROM words)
SELECT participant_id, paragraph, word::INTEGER AS word FROM k WHERE ptb_pos <> 'R'""")
def realigned_words(spark: SparkSession, sf: str) -> DataFrame:
    w = roles.words(spark, sf)
    keys = ["participant_id", "paragraph"]
    return joins.shift_after_drop(w.select(*keys, "word"), w.where("ptb_pos = 'R'").select(*keys, "word"), keys, "word").withColumn("word", F.col("word").cast("int"))


@query(W + """
SELECT DISTINCT n.participant_id FROM meta n WHERE n.native AND EXISTS (SELECT 1 FROM meta l WHERE NOT l.native AND l.content_group = n.content_group AND l.lang_no % 3 = n.lang_no % 3)""")
def shared_combos(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.readers(spark, sf).withColumn("combo", F.col("lang_no") % 3)
    return filters.shared_combos(r.where("native"), r.where("not native"), ["content_group", "combo"]).select("participant_id")


@query(W + """
SELECT coalesce(content_group, 'All') AS content_group, count(*) FILTER (native) AS native, count(*) FILTER (NOT native) AS second, count(*) AS "All"
FROM meta GROUP BY ROLLUP (content_group)""")
def crosstab_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.readers(spark, sf).withColumn("side", F.when(F.col("native"), "native").otherwise("second"))
    return features.counts_with_totals(r, "content_group", "side", ["native", "second"])


@query(W + """
SELECT coalesce(L1, 'All') AS "L1", count(*) AS count FROM meta GROUP BY ROLLUP (L1)""")
def language_totals(spark: SparkSession, sf: str) -> DataFrame:
    return features.totals_by_rollup(roles.readers(spark, sf), "L1")


@query(W + """, n AS (SELECT participant_id, count(DISTINCT paragraph) n FROM words0 GROUP BY 1)
SELECT m.participant_id, coalesce(n, 0) AS n_paragraphs FROM meta m LEFT JOIN n USING (participant_id)""")
def paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.paragraph_counts(roles.readers(spark, sf).select("participant_id"), roles.words(spark, sf, numbered=False), "participant_id", "paragraph")


@query(W + """, x AS (SELECT participant_id, count(*) n, sum(word_length) x, sum(word_length * word_length) xx, sum(ff) y, sum(word_length * ff) xy FROM words0 GROUP BY 1)
SELECT participant_id, n AS n_rows, round((y - (n * xy - x * y) / (n * xx - x * x) * x) / n + 3e-6, 4) + 0.0 AS b_0, round((n * xy - x * y) / (n * xx - x * x) + 3e-6, 4) + 0.0 AS b_word_length
FROM x WHERE n * xx - x * x > 1e-9""")
def wp_coefs_ols(spark: SparkSession, sf: str) -> DataFrame:
    df = features.linear_coefficients(roles.words(spark, sf, numbered=False), ["participant_id"], "ff", ["word_length"])
    return rounded_all(df.where("b_0 is not null"), 4, "b_0", "b_word_length")


@query(W + ", " + least_squares("words0", "participant_id", "fp", ["word_length", "frequency", "surprisal"]) + """
SELECT participant_id, n AS n_rows, round(b_0, 3) + 0.0 AS b_0, round(b_1, 3) + 0.0 AS b_word_length, round(b_2, 2) + 0.0 AS b_frequency, round(b_3, 2) + 0.0 AS b_surprisal FROM ls WHERE n >= 8""")
def wp_coefs_three(spark: SparkSession, sf: str) -> DataFrame:
    """Of readers with twice as many words as coefficients."""
    out = features.linear_coefficients(roles.words(spark, sf, numbered=False), ["participant_id"], "fp", ["word_length", "frequency", "surprisal"]).where("n_rows >= 8")
    return rounded_all(rounded_all(out, 3, "b_0", "b_word_length"), 2, "b_frequency", "b_surprisal")


@query()
def wp_coefs_logit(spark: SparkSession, sf: str) -> DataFrame:
    return features.logistic_coefficients(roles.words(spark, sf, numbered=False), ["participant_id"], "sk", ["word_length", "frequency"])


@query("""
SELECT conv_id, turn, role, lag(role) OVER w AS before, (row_number() OVER w - 1)::INTEGER AS place, ((row_number() OVER w - 1) % 2)::INTEGER AS side
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def turn_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    order = ["turn", "role", "text"]
    c = c.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy(*order)))
    c = windows.running_number(c, ["conv_id"], order, "place")
    return windows.parity_split(c, ["conv_id"], order).select("conv_id", "turn", "role", "before", F.col("place").cast("int").alias("place"), F.col("side").cast("int").alias("side"))


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 2""")
def second_order(spark: SparkSession, sf: str) -> DataFrame:
    return windows.nth(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey", "o_orderdate")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count({c}) AS filled FROM lineitem""" for c in _NUMBERS))
def footer_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """What the files' footers say of the line items' numbers."""
    return sources.column_ranges(spark, f"{sf}/lineitem.parquet", _NUMBERS)
