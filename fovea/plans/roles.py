"""The driver tables in the roles of words, readers and fixations, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fovea.sources import table

METRICS = {"ff": "ff", "fp": "fp", "tf": "tf", "rp": "rp", "sk": "sk", "rr": "rr"}
TAGS = ("A", "N", "R")
CODES = {"signup": 1, "error": 2, "click": 3, "view": 4, "purchase": 5}


def readers(spark: SparkSession, sf: str) -> DataFrame:
    """A row a customer: participant_id, L1 (nation), native (from America), score (balance), content_group (segment)."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("L1"), (F.col("r_name") == "AMERICA").alias("native"), F.col("r_name").alias("region"))
    c = table(spark, sf, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("participant_id"), "L1", "native", "region", F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("content_group"), F.col("n_nationkey").alias("lang_no"))


def words(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    """A row a line item: participant (customer), paragraph (ship year, 1 to 7), word, tags, reading measures.

    `numbered` gives words their place in the trial, by the whole row; only queries that need it pay for the sort.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    df = i.select(
        F.col("o_custkey").alias("participant_id"), (F.year("l_shipdate") - 1994).alias("paragraph"), F.concat(F.col("o_custkey").cast("string"), F.lit("_"), (F.year("l_shipdate") - 1994).cast("string")).alias("trial"),
        F.col("l_returnflag").alias("ptb_pos"), F.col("l_linestatus").alias("universal_pos"), F.col("l_quantity").alias("ff"), F.col("l_extendedprice").alias("fp"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("tf"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("rp"), F.when(F.col("l_discount") < 0.02, 1.0).otherwise(0.0).alias("sk"), F.when(F.col("l_discount") > 0.05, F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)).alias("rr"),
        F.col("l_linenumber").cast("double").alias("word_length"), F.col("l_tax").alias("frequency"), F.col("l_discount").alias("surprisal"), F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ship_date"),
    )
    if not numbered:
        return df
    place = Window.partitionBy("trial").orderBy("order_key", "line", "part_key", "supp_key", "ff", "fp", "surprisal", "frequency", "ship_date", "ptb_pos", "universal_pos")
    return df.withColumn("word", (F.row_number().over(place) - 1).cast("int"))


def fixations(spark: SparkSession, sf: str, per: str = "month") -> DataFrame:
    """A row an event: participant (user), trial (user and month or day), word (code of the kind), duration, place."""
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    e = table(spark, sf, "events")
    when = F.date_format("ts", "yyyy-MM" if per == "month" else "yyyy-MM-dd")
    return e.select(F.col("user_id").alias("participant_id"), when.alias("paragraph"), code[F.col("event_type")].alias("word"), F.col("value").alias("duration"), "ts", "event_id")


SQL = """
WITH meta AS (
  SELECT c_custkey AS participant_id, n_name AS L1, r_name = 'AMERICA' AS native, r_name AS region, c_acctbal AS score,
    c_mktsegment AS content_group, n_nationkey AS lang_no
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
words0 AS (
  SELECT o_custkey AS participant_id, year(l_shipdate) - 1994 AS paragraph,
    o_custkey::VARCHAR || '_' || (year(l_shipdate) - 1994)::VARCHAR AS trial, l_returnflag AS ptb_pos, l_linestatus AS universal_pos,
    l_quantity AS ff, l_extendedprice AS fp, l_extendedprice * (1 - l_discount) AS tf, l_extendedprice * (1 + l_tax) AS rp,
    CASE WHEN l_discount < 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sk,
    CASE WHEN l_discount > 0.05 THEN CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS rr,
    l_linenumber::DOUBLE AS word_length, l_tax AS frequency, l_discount AS surprisal, l_orderkey AS order_key, l_partkey AS part_key,
    l_suppkey AS supp_key, l_linenumber AS line, l_shipdate AS ship_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
words AS (
  SELECT *, (row_number() OVER (PARTITION BY trial ORDER BY order_key, line, part_key, supp_key, ff, fp, surprisal, frequency,
    ship_date, ptb_pos, universal_pos) - 1)::INTEGER AS word
  FROM words0),
fix AS (
  SELECT user_id AS participant_id, strftime(ts, '%Y-%m') AS paragraph,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 END AS word,
    value AS duration, ts, event_id
  FROM events)"""
