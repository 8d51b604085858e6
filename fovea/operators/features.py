"""Feature rows per participant, item or window, from word and fixation tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators import gram


def reading_speed(words: DataFrame, who: Sequence[str], trial: str, duration: str) -> DataFrame:
    """Words per minute: all words over the sum of the trials' durations (milliseconds, one value a trial)."""
    trials = words.groupBy(*who, trial).agg(F.count(F.lit(1)).alias("n"), F.min(duration).alias("ms"))
    return trials.groupBy(*who).agg(F.try_divide(F.sum("n"), F.sum("ms") / 60000.0).alias("reading_speed"))


def metric_means(words: DataFrame, who: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """The mean of each metric over the rows that have it. metrics: name -> column."""
    return words.groupBy(*who).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(name) for name, c in metrics.items()])


def clusters(words: DataFrame, who: Sequence[str], tag: str, tags: Sequence[str], metrics: Mapping[str, str], normalized: bool = False) -> DataFrame:
    """Long form: who, tag, one column a metric: its mean over the participant's words with the tag.

    `normalized` divides by the participant's mean over all words with an allowed tag.
    """
    allowed = words.where(F.col(tag).isin(*tags))
    means = metric_means(allowed, [*who, tag], metrics)
    if not normalized:
        return means
    whole = metric_means(allowed, who, {f"_{name}": c for name, c in metrics.items()})
    return means.join(whole, list(who)).select(*who, tag, *[F.try_divide(F.col(m), F.col(f"_{m}")).alias(m) for m in metrics])


def wide_clusters(long: DataFrame, who: Sequence[str], tag: str, tags: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row a participant, a column for each tag and metric; a tag nobody has still gives null columns."""
    return long.groupBy(*who).pivot(tag, list(tags)).agg(*[F.first(m).alias(m) for m in metrics])


def _solve(moments: Sequence[str], response: Sequence[str], size: int, names: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            a = df[list(moments)].to_numpy(float).reshape(-1, size, size)
            b = df[list(response)].to_numpy(float)
            out = np.full((len(df), size), np.nan)
            for k in range(len(df)):
                if np.isfinite(a[k]).all() and np.isfinite(b[k]).all() and np.linalg.matrix_rank(a[k]) == size:
                    out[k] = np.linalg.solve(a[k], b[k])
            rest = df.drop(columns=[*moments, *response])
            for j, name in enumerate(names):
                rest[name] = pd.Series(np.where(np.isfinite(out[:, j]), out[:, j], np.nan), index=rest.index)
            yield rest

    return run


NARROW = 8


def _wide_coefficients(full: DataFrame, who: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    k, names = len(xs), ["b_0", *[f"b_{x}" for x in xs]]
    blocks = gram.sums_by(full, who, y, xs)
    kept = [f for f in blocks.schema.fields if f.name in who]

    def solve(table: pa.Table) -> pa.Table:
        sums = gram.Sums.unpacked(k, zip(*(table.column(c).to_pylist() for c in ("i", "j", "payload")), strict=True))
        n, total, _ = sums.head
        square = np.block([[np.array([[n]]), np.diag(sums.first)[None, :]], [np.diag(sums.first)[:, None], sums.product]])
        fits = np.linalg.matrix_rank(square) == k + 1
        found = np.linalg.solve(square, np.concatenate([[total], sums.xy])) if fits else [None] * (k + 1)
        return pa.table({f.name: table.column(f.name).slice(0, 1) for f in kept} | {"n_rows": pa.array([int(n)])} | {c: pa.array([v], pa.float64()) for c, v in zip(names, found, strict=True)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_rows long", *(f"`{n}` double" for n in names)])
    return blocks.groupBy(*who).applyInArrow(solve, schema)


def linear_coefficients(df: DataFrame, who: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares of y on xs with an intercept for each group: b_0 and one b_<x>; null if not determined.

    Sums of products are Spark aggregates with partial sums in the map side; only a small system a group is solved.
    Beyond NARROW columns the sums are blocks (`gram`), so the plan doesn't grow with their square.
    """
    if len(xs) > NARROW:
        return _wide_coefficients(df.dropna(subset=[y, *xs]), who, y, xs)
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    full = df.dropna(subset=[y, *xs])
    moments, response = [], []
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            moments.append(f"_m{i}_{j}")
            aggs.append(F.sum(a * b).alias(moments[-1]))
        response.append(f"_r{i}")
        aggs.append(F.sum(a * F.col(y).cast("double")).alias(response[-1]))
    names = ["b_0", *[f"b_{x}" for x in xs]]
    sums = full.groupBy(*who).agg(*aggs)
    kept = [f for f in sums.schema.fields if f.name in who or f.name == "n_rows"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` double" for n in names])
    return sums.mapInPandas(_solve(moments, response, len(terms), names), schema)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.0, rounds: int = 100) -> np.ndarray | None:
    """Newton's method; x holds its own constant column, which isn't penalised. None if it doesn't settle or separates."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        try:
            step = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ w)
        except np.linalg.LinAlgError:
            return None
        w = w + step
        if not np.isfinite(w).all():
            return None
        if np.abs(step).max() < 1e-9:
            return w
    return None


#: A slope beyond this is no estimate.
STEEPEST = 10.0


def separated(x: np.ndarray, y: np.ndarray, w: np.ndarray, steepest: float = STEEPEST) -> bool:
    """Whether a likelihood has no proper maximum at w: doubling w doesn't hurt, or a slope is too steep to believe."""

    def likelihood(v: np.ndarray) -> float:
        s = x @ v
        return float((y * s - np.logaddexp(0, s)).sum())

    return not np.isfinite(likelihood(w)) or likelihood(2 * w) >= likelihood(w) or np.abs(w[1:]).max(initial=0) > steepest


def logistic_fits(x: np.ndarray, y: np.ndarray, starts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """`logistic_fit` of many groups of rows at once, a row of coefficients each; NaN where y is constant, unsettled or `separated`."""
    sizes = np.diff([*starts, len(y)])
    group = np.repeat(np.arange(len(starts)), sizes)
    out = np.full((len(starts), x.shape[1]), np.nan)
    ones = np.add.reduceat(y, starts)
    live = (ones > 0) & (ones < sizes)
    w = np.zeros_like(out)
    for _ in range(rounds):
        if not live.any():
            break
        rows, at = live[group], np.flatnonzero(live)
        first = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
        a, own = x[rows], group[rows]
        p = 1 / (1 + np.exp(-np.clip((a * w[own]).sum(axis=1), -500, 500)))
        hessian = np.add.reduceat(a[:, :, None] * a[:, None, :] * (p * (1 - p))[:, None, None], first)
        slope = np.add.reduceat(a * (y[rows] - p)[:, None], first)
        try:
            step = np.linalg.solve(hessian, slope[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # some group's matrix is singular: each by itself
            step = np.full_like(slope, np.nan)
            for k in range(len(at)):
                with contextlib.suppress(np.linalg.LinAlgError):
                    step[k] = np.linalg.solve(hessian[k], slope[k])
        w[at] += step
        settled = np.abs(step).max(axis=1) < 1e-9
        out[at[settled]] = w[at[settled]]
        live[at[settled | ~np.isfinite(w[at]).all(axis=1)]] = False
    s = (x * np.nan_to_num(out)[group]).sum(axis=1)
    once, twice = (np.add.reduceat(y * v - np.logaddexp(0, v), starts) for v in (s, 2 * s))
    out[~np.isfinite(once) | (twice >= once) | (np.abs(np.nan_to_num(out[:, 1:])).max(axis=1, initial=0) > STEEPEST)] = np.nan
    return out


def logistic_coefficients(df: DataFrame, who: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Logistic regression of a 0/1 metric for each group: b_0, b_<x>; null where y is constant, unsettled or separated.

    A group is one participant's words and is fitted in one task, thousands of groups at once.
    """
    names = ["b_0", *[f"b_{x}" for x in xs]]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in who)
    order = [f.name for f in df.schema.fields if f.name in who]

    def fitted(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, target = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1), t.column("_y").to_numpy()
        w = logistic_fits(np.column_stack([np.ones(len(t)), x]), target, starts)
        columns = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in w.T.copy()]
        yield from pa.table([*(t.column(k).take(pa.array(starts)) for k in order), *columns], names=[*order, *names]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _starts(t, order)
            last = int(starts[-1])
            if last:
                yield from fitted(t.slice(0, last).combine_chunks(), starts[:-1])
            held = t.slice(last).combine_chunks().to_batches()  # the last group may go on
        if held:
            yield from fitted(pa.Table.from_batches(held), np.zeros(1, np.int64))

    rows = df.dropna(subset=[y, *xs]).select(*order, F.col(y).cast("double").alias("_y"), F.array(*[F.col(x).cast("double") for x in xs]).alias("_x"))
    dealt = rows.repartition(*order).sortWithinPartitions(*order) if order else rows.repartition(1)
    return dealt.mapInArrow(run, ", ".join([*([keys] if keys else []), *(f"`{n}` double" for n in names)]))


def _starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows at which another key begins, in a table sorted by the keys."""
    new = np.zeros(max(0, len(t) - 1), bool)
    for k in keys:
        a, b = t.column(k).slice(0, len(t) - 1), t.column(k).slice(1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (a.is_null().to_numpy() != b.is_null().to_numpy())
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def transitions(fixations: DataFrame, who: Sequence[str], paragraph: str, current: str, following: str) -> DataFrame:
    """Long form: who, paragraph, i, j, value: how often the eyes went from word i to word j, both on the text."""
    good = fixations.where((F.col(current) >= 0) & (F.col(following) >= 0))
    return good.groupBy(*who, paragraph, F.col(current).alias("i"), F.col(following).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def word_dwell(words: DataFrame, who: Sequence[str], paragraph: str, word: str, metrics: Mapping[str, str]) -> DataFrame:
    """Long form: who, paragraph, word, metric, value; repeated rows are averaged."""
    long = words.select(*who, paragraph, word, *[F.col(c).cast("double").alias(m) for m, c in metrics.items()]).unpivot([*who, paragraph, word], list(metrics), "metric", "value")
    return long.groupBy(*who, paragraph, word, "metric").agg(F.avg("value").alias("value"))


def zero_filled(values: DataFrame, read: DataFrame, who: Sequence[str], paragraph: str, cell: Sequence[str]) -> DataFrame:
    """Every known cell of each read paragraph: 0 where nothing happened. Unread paragraphs have no rows.

    values: who, paragraph, cell, value; read: the (who, paragraph) pairs that were read. The join is on the paragraph.
    """
    domain = values.select(paragraph, *cell).distinct()
    full = read.select(*who, paragraph).distinct().join(domain, paragraph)
    return full.join(values, [*who, paragraph, *cell], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def misaligned(words: DataFrame, keys: Sequence[str], label: str, samples: int = 5) -> DataFrame:
    """Word positions with more than one label, with how many and a few of them: empty if texts agree."""
    return words.groupBy(*keys).agg(F.countDistinct(label).alias("labels"), F.slice(F.sort_array(F.collect_set(label)), 1, samples).alias("samples")).where("labels > 1")


def content_group(words: DataFrame, who: str, batch: str, article: str, level: str) -> DataFrame:
    """who, batch, content_group: the batch with the level of the participant's second article in it."""
    articles = words.groupBy(who, batch, article).agg(F.min(level).alias("_level"))
    second = articles.groupBy(who, batch).agg(F.sort_array(F.collect_list(F.struct(article, "_level"))).alias("_all")).where(F.size("_all") >= 2)
    return second.select(who, batch, F.concat_ws("_", F.col(batch).cast("string"), F.col("_all")[1]["_level"].cast("string")).alias("content_group"))


def paragraph_counts(people: DataFrame, words: DataFrame, who: str, paragraph: str) -> DataFrame:
    """n_paragraphs of everyone in people, 0 for who read none."""
    return people.join(words.groupBy(who).agg(F.countDistinct(paragraph).alias("n_paragraphs")), who, "left").withColumn("n_paragraphs", F.coalesce("n_paragraphs", F.lit(0)))


def mean_over(df: DataFrame, who: Sequence[str], value: str, first: Sequence[str] = ()) -> DataFrame:
    """Mean value and the least of the other columns for each key: directions or items to one row a participant."""
    return df.groupBy(*who).agg(F.avg(value).alias(value), *[F.min(c).alias(c) for c in first])


def counts_with_totals(people: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Participants by row and column, with an All column and an All row."""
    table = people.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    table = table.withColumn("All", sum((F.col(v) for v in values[1:]), F.col(values[0])))
    total = table.agg(F.lit("All").alias(row), *[F.sum(c).alias(c) for c in [*values, "All"]])
    return table.unionByName(total)


def totals_by_rollup(people: DataFrame, key: str) -> DataFrame:
    return people.rollup(key).count().withColumn(key, F.coalesce(key, F.lit("All")))


GROUPS = {"fixation_metrics": metric_means, "clusters": clusters, "reading_speed": reading_speed}


def feature_groups(requested: Mapping[str, DataFrame], who: Sequence[str]) -> DataFrame:
    """One row a participant: the frames of the requested groups side by side, everybody kept."""
    out = None
    for frame in requested.values():
        out = frame if out is None else out.join(frame, list(who), "full_outer")
    return out


def text_features(frames: Mapping[str, DataFrame], who: Sequence[str], paragraph: str) -> DataFrame:
    """who, paragraph, feature_group, cell, value: per-text frames in one long table instead of ever wider ones."""
    out = None
    for name, df in frames.items():
        cells = [c for c in df.columns if c not in (*who, paragraph, "value")]
        one = df.select(*who, paragraph, F.lit(name).alias("feature_group"), F.concat_ws("_", *[F.col(c).cast("string") for c in cells]).alias("cell"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
