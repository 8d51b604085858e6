"""Exact top-k by inner product over a pivot-distance index.

Vectors are turned into integers, floor(scale * x). With M the greatest length, x gets one more coordinate,
sqrt(M^2 - |x|^2), and a query q a zero: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are
the nearest points. Each vector is keyed by its nearest pivot and its distance to that. Sorted by key, the vectors
of a pivot are cut into annuli. A query ranks the annuli by the best score the triangle inequality allows in them,
searches the first few, and goes on to the next only while their bound reaches its k-th score.

Pivots come from a sample of at most `max_sample` vectors, by farthest-first choice; every row is indexed. There
are at most about `max_annuli` annuli, so their table (pivot, inner and outer radius) is a bounded broadcast.
Queries are shuffled to the annuli they search; an annulus that many queries want is copied, so no group holds more
than `group_queries` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm.storage import keep

MAX_SAMPLE = 4096
MAX_ANNULI = 50_000
SCORE_CELLS = 2_000_000


def _farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    apart = np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if apart.max() <= 0:
            break
        chosen.append(int(apart.argmax()))
    return points[chosen]


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))])


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows, pivots)."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v array<double> of whole numbers; without null ids, null or empty vectors, null or non-finite components."""
    x = F.transform(F.col(vec_col), lambda e: F.floor(e.cast("double") * scale).cast("double"))
    fine = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, pivots: int = 64, annulus_rows: int = 2048, max_sample: int = MAX_SAMPLE, max_annuli: int = MAX_ANNULI, group_queries: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows, all if there are fewer.

    Ties go to the smaller id. `is_query` is a condition on the id column named `id`. Vectors that are null or empty
    or hold null or non-finite components take no part; shorter ones count as padded with zeros. Rows that repeat
    an id are all candidates, but not for a query of that id, which is asked once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    raw = _integers(vectors, id_col, vec_col, scale)
    shape = raw.select(F.size("v").alias("size"), F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e).alias("square")).agg(F.max("size"), F.max("square"), F.count(F.lit(1))).first()
    size, most, rows = shape[0] or 1, shape[1] or 0.0, shape[2]
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    padded = raw.select("id", F.concat("v", F.array_repeat(F.lit(0.0), size - F.size("v"))).alias("v"))
    sample = padded.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v") if rows > max_sample else padded.select("v")
    points = np.array([r[0] for r in sample.collect()], float).reshape(-1, size)
    shared = spark.sparkContext.broadcast((_farthest_first(_lifted(points, most), pivots), most))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, top = shared.value
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(-1, size)
                far = _apart(_lifted(v, top), centres)
                near = far.argmin(axis=1)
                cells = pa.array([r.astype("<f8").tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), cells, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(v)), near])], names=["id", "v", "pivot", "far"])

    height = max(annulus_rows, -(-rows // max_annuli))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, filled, pivot = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            labels = []
            for p in batch.column(2).to_pylist():
                if p != pivot or filled == height:
                    label, filled, pivot = label + 1, 0, p
                labels.append(label)
                filled += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int64())], names=[*batch.schema.names, "annulus"])

    keyed = padded.mapInArrow(key, "id long, v binary, pivot int, far double").repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far")
    index = keep(keyed.mapInArrow(cut, "id long, v binary, pivot int, far double, annulus long"))
    rings = np.array([tuple(r) for r in index.groupBy("annulus").agg(F.first("pivot"), F.min("far"), F.max("far")).orderBy("annulus").collect()], float).reshape(-1, 4)
    ring_table = spark.sparkContext.broadcast((rings[:, 0].astype(np.int64), rings[:, 1].astype(int), rings[:, 2], rings[:, 3]))
    queries = index.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumnRenamed("id", "query")

    def plan(first: int, end: int):
        """The annuli ranked first..end by bound, if the bound reaches the query's k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (centres, top), (labels, pivot, inner, outer) = shared.value, ring_table.value
            for batch in batches:
                for part in (batch.slice(s, 500) for s in range(0, batch.num_rows, 500)):
                    q = _matrix(part.column(1))
                    far = _apart(np.column_stack([q, np.zeros(len(q))]), centres)[:, pivot]
                    gap = np.maximum(np.maximum(far - outer, inner - far), 0)
                    reach = (q * q).sum(axis=1)[:, None] + top
                    bound = (reach - gap * gap) / 2 + 1 + 1e-9 * reach
                    ranked = np.argsort(-bound, axis=1, kind="stable")[:, first:end]
                    worst = part.column(2).fill_null(-(1 << 62)).to_numpy()
                    who, at = np.nonzero(np.take_along_axis(bound, ranked, 1) >= worst[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(labels[ranked[who, at]]), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who))], names=["annulus", "query", "v"])

        return run

    def best(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            ids, x = held["id"].to_numpy(), _matrix(held["v"].combine_chunks())
            names = asked["query"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            q = _matrix(asked["v"].combine_chunks())
            exact = np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2**53
            if not exact:
                q, x = q.astype(np.int64), x.astype(np.int64)
            step = max(1, SCORE_CELLS // len(x))
            for first in range(0, len(q), step):
                for name, s in zip(names[first : first + step], (q[first : first + step] @ x.T).astype(np.int64), strict=True):
                    others = ids != name
                    own, ranked = s[others], ids[others]
                    head = np.argsort(-own, kind="stable")[:k]
                    found.append((np.full(len(head), name), ranked[head], own[head]))
        columns = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found: DataFrame | None = None
    first, width = 0, 4
    while first < len(rings) or found is None:
        state = queries.withColumn("worst", F.lit(None).cast("long"))
        if found is not None:
            kth = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
            state = queries.join(kth, "query", "left")
        visits = keep(state.select("query", "v", "worst").mapInArrow(plan(first, first + width), "annulus long, query long, v binary"))
        wanted = visits.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / group_queries).cast("int").alias("copies"))
        if found is not None and not visits.limit(1).count():
            break
        asked = visits.join(wanted, "annulus").select("annulus", F.pmod(F.xxhash64("query"), F.col("copies")).cast("int").alias("copy"), "query", "v")
        held = index.join(wanted, "annulus").select("annulus", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "id", "v")
        more = asked.groupBy("annulus", "copy").cogroup(held.groupBy("annulus", "copy")).applyInArrow(best, "query long, id long, score long")
        merged = more if found is None else more.unionByName(found.select("query", "id", "score"))
        found = keep(merged.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k))
        first, width = first + width, width * 4
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
