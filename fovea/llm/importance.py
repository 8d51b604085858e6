"""Importance resampling towards a target distribution, by hashed runs of words.

A document's features are its runs of 1 to `longest` words. One scan keeps the running zlib states of the last
`longest` starts; a word extends each by a space and itself, and every state reached is a feature's CRC-32, whose
remainder is its bucket. Texts are thus read once: what stays is each document's buckets with their counts. A
bucket's gain is the log ratio of its smoothed shares in target and corpus; a document's weight is the floored
mean gain of its features, its score adds Gumbel noise from a hash of its key, so the highest scores are a draw
without replacement in proportion to the weights' exponentials.

Main cost: one pass over the texts; buckets are summed in each task before the shuffle. Gains are one number a
bucket. The draw sorts (score, key) in ranges, never all rows in one task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.llm.storage import fresh, keep
from fovea.operators.ranks import positions

BUCKETS = 10_000
SLICE_BYTES = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text in lists, cut where a word has ended."""
    first = 0
    while first < len(text):
        gap = _GAP.search(text, first + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text[first:end])
        first = end


def ring(text: bytes, longest: int) -> tuple[np.ndarray, int]:
    """CRC-32 of every run of 1 to `longest` words, A-Z folded, joined by spaces; and the number of words."""
    crc, out, states, n = zlib.crc32, [np.zeros(0, np.uint32)], [], 0
    for words in slices(text.lower()):
        found = []
        for word in words:
            spaced = b" " + word
            states = [crc(spaced, s) for s in states[-longest + 1 :]] if longest > 1 else []
            states.append(crc(word))
            found += states
        out.append(np.array(found, np.uint32))
        n += len(words)
    return np.concatenate(out), n


def features(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_features, buckets and counts (arrays of equal length). Null text has none."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, own, times = [], [], [], []
            for text in batch.column(1):
                hashes, n = ring(text.as_py() or b"", longest)
                bucket, count = np.unique(hashes % buckets, return_counts=True)
                n_words.append(n)
                n_features.append(len(hashes))
                own.append(bucket.astype(np.int32))
                times.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(own, schema.field(3).type), pa.array(times, schema.field(4).type)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents. The driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in found.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    size, all_t, all_s = len(target), float(target.sum() + len(target)), float(corpus.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((target[b] + 1.0) * all_s / ((corpus[b] + 1.0) * all_t))) for b in range(size)], np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features, 0 without any."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            parts = gain[batch.column(3).flatten().to_numpy()] * batch.column(4).flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(parts)])
            lengths = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            total = sums[lengths[1:]] - sums[lengths[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total // np.maximum(n, 1))], schema=schema)

    return found.select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank.

    Of the N documents with at least `min_words` words, the floor(percent N / 100) with the highest scores are
    drawn and ranked from 1, ties to the smaller key; the others' rank is null. Null or empty text has no
    features and weight 0; a null key has a null score, is never drawn and not counted in N. Repeated rows are
    scored each and may both be drawn. An empty corpus gives no rows; an empty target only its smoothing.
    Other columns are ignored.
    """
    found = keep(features(docs, longest, buckets, id_col, text_col))
    aims = features(target.select(F.crc32(F.col(target_id).cast("string")).alias("doc_id"), F.col(target_text).alias("text")), longest, buckets)
    gain = gains(bucket_counts(aims, buckets), bucket_counts(found, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    row, enough = fresh(["doc_id", "n_features", "weight", "score", "rank"], "row", "enough")
    scored = weigh(found, gain).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn(enough, (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    scored = keep(scored.withColumn(row, F.monotonically_increasing_id()))
    drawn = scored.where(enough).count() * percent // 100
    ranked = positions(scored.where(enough), F.desc("score"), "doc_id", row, name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(scored.where(~F.col(enough)).withColumn("rank", F.lit(None).cast("long")).select(out))
