"""Ridge on more columns than people, from long rows (person, feature, value): the people's kernel instead of X'X.

Cells are dealt by feature, so a task has whole columns: it scales each on its training people, lays a few hundred
side by side and adds their products to the matrix of people by people. Those matrices are added up where they stream
in, one a group and fold. Nothing is pivoted, a gap costs nothing and counts as the mean, people without any cell
stay. One decomposition a group and fold gives every penalty's leave-one-out errors and the predictions.

A feature that one person alone has is 0 in every fit and goes first. People whom no chain of shared features joins
have a 0 between them, so a group's matrix falls into blocks: its people are dealt into bins of whole chains, each bin
is decomposed by itself, and only errors by penalty meet in the group. A task holds a bin's matrix for each fold: some
thousands of people where all share features, a hundred where features are rare, however many people the group has.
The number of features is free. With more people in one chain and fewer columns, `gram` is the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators.gram import summed
from fovea.operators.models import ALPHAS
from fovea.sources.shared import keep

SIDE_BY_SIDE = 512
#: People of small chains share a bin of about so many; bins of more than WHOLE people are dealt by feature.
BIN_PEOPLE, WHOLE = 128, 1024
_ALL = -1  # the fold of those who leave one out


def _number(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


class _Kernels:
    """One group's matrices by fold, fed with whole columns."""

    def __init__(self, people: int, folds: int):
        self.folds = range(folds) if folds else [_ALL]
        self.matrix = {f: np.zeros((people, people)) for f in self.folds}
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.people = people

    def add(self, at: np.ndarray, fold: np.ndarray, trains: np.ndarray, value: np.ndarray) -> None:
        self.waiting.append((at, fold, trains, value))
        if len(self.waiting) >= SIDE_BY_SIDE:
            self.flush()

    def flush(self) -> None:
        for f in self.folds if self.waiting else ():
            z = np.zeros((self.people, len(self.waiting)))
            for j, (at, fold, trains, value) in enumerate(self.waiting):
                own = value[trains & (fold != f)]
                if len(own) > 1:
                    sd = own.std(ddof=1)
                    mean = own.mean()
                    z[at, j] = (value - mean) / (sd if sd * sd > 1e-12 * max(1.0, mean * mean) else 1.0)
                elif len(own):
                    z[at, j] = value - own[0]
            self.matrix[f] += z @ z.T
        self.waiting.clear()


def solved(kernel: np.ndarray, y: np.ndarray, fold: np.ndarray, f: int, alphas: Sequence[float], n: float, middle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The people of a bin that fold f is about, their predictions by each penalty, and the bin's leave-one-out errors by
    penalty. f is one fold, predicted by the others, or _ALL: everybody by all others. n and middle are the number and
    the mean target of the whole group's training people."""
    train = np.flatnonzero(~np.isnan(y) & (fold != f))
    asked = np.flatnonzero(fold == f) if f != _ALL else np.arange(len(y))
    out = np.full((len(y), len(alphas)), np.nan)
    if n < 2:
        return asked, out[asked], np.zeros(len(alphas))
    own = y[train]
    s, u = np.linalg.eigh(kernel[np.ix_(train, train)])
    s, along = np.maximum(s, 0), u.T @ (own - middle)
    below = s[:, None] + np.asarray(alphas, float)[None, :]
    share = np.divide(s[:, None], below, out=np.zeros_like(below), where=below > 0)
    left = 1 - 1 / n - (u * u) @ share
    loo = own[:, None] - (own[:, None] - middle - u @ (share * along[:, None])) / np.where(np.abs(left) > 1e-10, left, np.nan)
    error = ((own[:, None] - loo) ** 2).sum(axis=0)
    weights = u @ np.divide(along[:, None], below, out=np.zeros_like(below), where=below > 1e-10 * max(1.0, s.max(initial=0)))
    tested = asked if f != _ALL else np.flatnonzero(np.isnan(y))
    out[tested] = middle + kernel[np.ix_(tested, train)] @ weights
    if f == _ALL:
        out[train] = loo
    return asked, out[asked], error


def _chains(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _at, _chain of the people in `cells` (keys, _feature, _at): the least _at that shared features lead to.

    The least of a feature's people goes to all of them, and each takes the label of its label too: rounds grow with
    the logarithm of a chain. A round is two grouped minima.
    """
    labels = keep(cells.select(*keys, "_at").distinct().withColumn("_chain", F.col("_at")))
    while True:
        low = cells.join(labels, [*keys, "_at"]).groupBy(*keys, "_feature").agg(F.min("_chain").alias("_low"))
        met = cells.join(low, [*keys, "_feature"]).groupBy(*keys, "_at").agg(F.min("_low").alias("_low"))
        nearer = labels.join(met, [*keys, "_at"]).select(*keys, "_at", "_chain", F.least("_chain", "_low").alias("_low"))
        theirs = nearer.select(*keys, F.col("_at").alias("_low"), F.col("_low").alias("_next"))
        new = keep(nearer.join(theirs, [*keys, "_low"]).select(*keys, "_at", F.least("_low", "_next").alias("_new"), "_chain"))
        labels = new.select(*keys, "_at", F.col("_new").alias("_chain"))
        if new.where("_new < _chain").isEmpty():
            return labels


def ridge(cells: DataFrame, people: DataFrame, who: str, feature: str, value: str, target: str, groups: Sequence[str] = (), fold: str | None = None, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """groups, who, true, pred of everyone in `people` (one row a group and person).

    cells: groups, who, feature, value in long form; repeated cells of one feature are averaged, cells of others than
    `people` and null or non-finite values are left out. With `fold` each fold is predicted from the others, else each
    person from all others of the group; who has no target trains nobody and is predicted from all. Columns are scaled
    on the training people, gaps count as their mean. Alpha is that of least exact leave-one-out error in training.
    """
    by = Window.partitionBy(*(groups or [F.lit(0)]))
    code = (F.dense_rank().over(by.orderBy(fold)) - 1) if fold else F.lit(_ALL - 1)
    listed = people.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], *groups, who, _number(target).alias("_y"), code.cast("int").alias("_fold"), F.row_number().over(by.orderBy(who)).alias("_at"))
    # the group's number: its keys as they are may be null, which joins nothing
    same = [F.coalesce(F.col(f"_g{k}").cast("string"), F.lit("")) for k in range(len(groups))]
    void = [F.col(f"_g{k}").isNull().cast("string") for k in range(len(groups))]
    listed = listed.withColumns({"_at": F.col("_at") - 1, "_folds": (F.max("_fold").over(by) + 1) if fold else F.lit(0), "_group": F.to_json(F.array(*same, *void)) if groups else F.lit("")}).drop(*[f"_g{k}" for k in range(len(groups))])
    listed = keep(listed)
    fields = "_group string, _bin long, "
    names = ["_group", "_bin"]

    good = cells.select(*groups, who, F.col(feature).cast("string").alias("_feature"), _number(value).alias("_value")).where("abs(_value) < double('infinity') and _feature is not null")
    met = good.join(listed, [*groups, who]).groupBy("_group", "_feature", "_at", "_fold", "_folds", F.col("_y").isNotNull().alias("_trains")).agg(F.avg("_value").alias("_value"))
    met = keep(met)
    shared = met.groupBy("_group", "_feature").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group", "_feature")
    met = keep(met.join(shared, ["_group", "_feature"]))
    chains = _chains(met.select("_group", "_feature", "_at"), ["_group"])
    size = chains.groupBy("_group", "_chain").agg(F.count(F.lit(1)).alias("_size"))
    linked = size.groupBy("_group").agg(F.sum(F.when(F.col("_size") < BIN_PEOPLE, F.col("_size"))).alias("_few"))
    bins = F.ceil(F.coalesce("_few", F.lit(1)) / BIN_PEOPLE)
    bin_of = F.when(F.col("_size") < BIN_PEOPLE, -1 - F.pmod(F.xxhash64("_chain"), bins)).otherwise(F.col("_chain").cast("bigint"))
    placed = chains.join(size, ["_group", "_chain"]).join(linked, "_group").select("_group", "_at", bin_of.alias("_bin"))
    seat = Window.partitionBy("_group", "_bin")
    placed = keep(placed.withColumns({"_seat": F.row_number().over(seat.orderBy("_at")) - 1, "_people": F.count(F.lit(1)).over(seat).cast("int")}))
    joined = met.withColumnRenamed("_at", "_person").join(placed.withColumnRenamed("_at", "_person"), ["_group", "_person"]).withColumnRenamed("_seat", "_at")
    part = F.when(F.col("_people") > WHOLE, F.xxhash64("_feature")).otherwise(F.lit(0))
    dealt = joined.select("_group", "_bin", "_feature", "_at", "_fold", "_people", "_folds", "_trains", "_value").repartition(*names, part).sortWithinPartitions(*names, "_feature")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, column, parts, kinds = None, None, None, [], []

        def sent() -> pa.RecordBatch:
            held.flush()
            found = list(held.matrix.items())
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(found), t) for v, t in zip(group, kinds, strict=True)), pa.array([f for f, _ in found], pa.int32()), pa.array([m.tobytes() for _, m in found], pa.binary())], names=[*names, "_fold", "payload"])

        def whole() -> None:
            held.add(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            parts.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            kinds = [batch.schema.field(n).type for n in names]
            key = list(zip(*(col(n).to_pylist() for n in (*names, "_feature")), strict=True))
            at, own, value = (col(n).to_numpy() for n in ("_at", "_fold", "_value"))
            trains, sizes, folds = col("_trains").to_numpy(zero_copy_only=False), col("_people").to_numpy(), col("_folds").to_numpy()
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != column and parts:
                    whole()
                if key[a][:-1] != group:
                    if held:
                        yield sent()
                    group, held = key[a][:-1], _Kernels(int(sizes[a]), int(folds[a]))
                column = key[a]
                parts.append((at[a:b], own[a:b], trains[a:b], value[a:b]))
        if held:
            whole()
            yield sent()

    kernels = summed(dealt.mapInArrow(multiply, f"{fields}_fold int, payload binary"), [*names, "_fold"])
    within = listed.join(placed, ["_group", "_at"]).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_seat", "_at", "_y", F.col("_fold").alias("own")))).alias("_who"), F.first("_folds").alias("_folds"))
    every = F.explode(F.when(F.col("_folds") > 0, F.sequence(F.lit(0), F.col("_folds") - 1)).otherwise(F.array(F.lit(_ALL)))).alias("_fit")
    # n and mean target of each fit's training people, from the group's less the fold's own
    whole = listed.groupBy("_group").agg(F.count("_y").alias("_all_n"), F.sum("_y").alias("_all_y"), F.first("_folds").alias("_folds")).select("_group", "_all_n", "_all_y", every)
    own = listed.groupBy("_group", F.col("_fold").alias("_fit")).agg(F.count("_y").alias("_own_n"), F.sum("_y").alias("_own_y"))
    n, y = (F.col(f"_all_{c}") - F.coalesce(f"_own_{c}", F.lit(0)) for c in "ny")
    fits = keep(whole.join(own, ["_group", "_fit"], "left").select("_group", "_fit", n.alias("_n"), F.try_divide(y, n).alias("_middle")))
    whole_bins = within.select(*names, "_who", every).join(kernels.withColumnRenamed("_fold", "_fit"), [*names, "_fit"]).join(fits, ["_group", "_fit"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            for i in range(batch.num_rows):
                rows, f = col("_who")[i].as_py(), col("_fit")[i].as_py()
                y = np.array([np.nan if r["_y"] is None else r["_y"] for r in rows])
                kernel = np.frombuffer(col("payload")[i].as_buffer(), np.float64).reshape(len(y), len(y))
                asked, preds, error = solved(kernel, y, np.array([r["own"] for r in rows]), f, alphas, col("_n")[i].as_py(), col("_middle")[i].as_py() or 0.0)
                at = [None, *(rows[k]["_at"] for k in asked)]  # the first row holds the bin's errors
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([col("_group")[i].as_py()] * m), pa.array([f] * m, pa.int32()), pa.array(at, pa.int32()), pa.array([error.tolist(), *preds.tolist()], pa.list_(pa.float64()))], names=["_group", "_fit", "_at", "by_alpha"])

    found = keep(whole_bins.select("_group", "_fit", "_who", "payload", "_n", "_middle").mapInArrow(solve, "_group string, _fit int, _at int, by_alpha array<double>"))
    errors = found.where("_at is null").groupBy("_group", "_fit").agg(F.array(*[F.sum(F.col("by_alpha")[a]) for a in range(len(alphas))]).alias("_errors"))
    finite = F.transform("_errors", lambda e: F.when(F.abs(e) < F.lit(float("inf")), e).otherwise(F.lit(float("inf"))))
    best = errors.select("_group", "_fit", F.array_position(finite, F.array_min(finite)).cast("int").alias("_best"))
    linked = found.where("_at is not null").join(best, ["_group", "_fit"]).select("_group", "_at", F.element_at("by_alpha", F.col("_best")).alias("_pred"))
    # nobody else has the features of the rest: they are predicted by the mean of the fit's training people, but them
    fit = F.col("_fold") if fold else F.lit(_ALL)
    out = listed.withColumn("_fit", fit).join(fits, ["_group", "_fit"]).join(linked, ["_group", "_at"], "left")
    rest = F.when(F.col("_y").isNotNull(), F.try_divide(F.col("_middle") * F.col("_n") - F.col("_y"), F.col("_n") - 1)).otherwise(F.col("_middle")) if not fold else F.col("_middle")
    pred = F.when(F.col("_n") >= 2, F.coalesce(F.nanvl("_pred", F.lit(None)), F.when(F.col("_pred").isNull(), rest)))
    return out.select(*groups, who, F.col("_y").alias("true"), pred.alias("pred"))
