"""A cleaning pipeline over `documents`: language, toxicity, near duplicates, secrets, packing.

Each stage takes what the one before has kept. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.llm import jaccard, langid, packing, secret_scan, toxicity
from fovea.llm.storage import fresh, keep

#: SQL can't express the classifiers and the tokenizer.
ORACLE_SQL = None

#: Rows of texts that Spark hands to Python at a time, at most; they are held twice outside the heap.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a task beside the heap; a smaller bound of the session stays.

    A stage's rows are computed after it returns, so a stage leaves the setting; `run` puts the session's back.
    """
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with letters in a language that the model knows; null and letterless texts go."""
    in_small_batches(spark)
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.predict(docs, langid.fit(docs), lang_name=lang, score_name=score)
    return found.where(langid.accepted(lang_name=lang, score_name=score)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose toxicity score is below a half."""
    in_small_batches(spark)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, spans = fresh(docs.columns, "toxic_score", "toxic_spans")
    return toxicity.score(docs, chain, score_name=score, spans_name=spans).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8 or more): that with the smallest key.

    A row goes by its key and its text: unlike texts under one key are judged each, and of rows with equal key and
    text one stays. Texts without words are copies of nothing, rows without a key are left alone: both stay, repeats too.
    """
    in_small_batches(spark)
    mark, rows, group = fresh([*docs.columns, "n_shingles", "component_id"], "mark", "rows", "group")
    marked = docs.withColumn(mark, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    homes = jaccard.near_duplicates(marked, size=5, percent=80, id_col=mark).where("doc_id is not null and n_shingles > 0")
    homes = homes.select(F.col("doc_id").alias(mark), F.col("component_id").alias(group)).distinct()
    held = keep(marked.where(F.col(mark).isNotNull()).groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias(rows)).join(homes, mark))
    stays = held.groupBy(group).agg(F.min(F.struct("doc_id", mark, rows)).alias("first")).select("first.*")
    repeated = stays.where(F.col(rows) > 1).select("doc_id", mark)
    goes = held.select("doc_id", mark).join(stays.where(F.col(rows) == 1), ["doc_id", mark], "left_anti")
    single = marked.join(goes, ["doc_id", mark], "left_anti")
    return single.unionByName(marked.join(repeated, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces each secret by the name of its kind; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids."""
    in_small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BATCH)
    try:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)  # its pass over the texts is done when it returns
    finally:
        spark.conf.set(_BATCH, before)
