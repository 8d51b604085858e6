"""Nested leave-one-out ridge on one column without a system for each person.

The error that chooses a person's penalty is a sum over all others of squared residuals, each over (d - h) ** 2 with
the leverage h. Where h is small that is a short power series in h, so the sum follows from the moments of the group's
rows less the person's own. Leverages of a group add up to one: at most 1 / FAR rows have more than FAR, and those
few are summed one by one, as are groups of so few rows at all. A person who is one of these moves the others'
leverages, so their errors are summed over all rows, a chunk of the group a task. Nothing reaches the driver, the work
grows with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.sources.shared import keep

FAR = 0.01
#: Powers of a leverage; what is left out is below 1e-15 of the sum.
POWERS = 8
CHUNK_ROWS = 5000
_TOP = 2 * POWERS + 2


class _Group:
    """A group's sums in its own frame: v is the column less its mean, over the root of its sum of squares; t the target less its mean."""

    def __init__(self, row: dict, alphas: Sequence[float]):
        self.alphas = np.asarray(alphas, float)
        self.n, self.there, self.mean, self.square, self.middle = row["_n"], row["_c"], row["_m"] or 0.0, row["_q"] or 1.0, row["_my"]
        self.near = np.array(row["_near"], float).reshape(_TOP + 1, 3)
        self.gaps = np.array(row["_gaps"], float)
        far = row["_far"] or []
        self.v = np.array([np.nan if r["_v"] is None else r["_v"] for r in far], float)
        self.t = np.array([r["_t"] for r in far], float)
        seen = ~np.isnan(self.v)
        v, t = self.v[seen], self.t[seen]
        self.sums = {(p, q): self.near[p, q] + (v**p * t**q).sum() for p, q in ((0, 1), (1, 0), (1, 1), (2, 0))}
        self.total = self.sums[0, 1] + self.gaps[1] + self.t[~seen].sum()

    def others(self, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """Means, slopes and 1 / (sum of squares + penalty) by penalty, of everybody but each (v, t); v NaN where there is a gap."""
        seen = ~np.isnan(v)
        v, own = np.where(seen, v, 0.0), np.where(seen, t, 0.0)
        count = self.there - seen
        a = np.divide(self.sums[1, 0] - v, count, out=np.zeros(len(v)), where=count > 0)
        my = (self.total - t) / max(self.n - 1, 1)
        zz = np.maximum(self.sums[2, 0] - v * v - count * a * a, 0)
        zy = self.sums[1, 1] - v * t - a * (self.sums[0, 1] - own)
        var = np.divide(zz * self.square, count - 1, out=np.zeros(len(v)), where=count > 1)
        at = self.mean + a * np.sqrt(self.square)
        unit = np.where(var > 1e-12 * np.maximum(1.0, at * at), var, 1.0) / self.square
        below = zz[:, None] + self.alphas * unit[:, None]
        inverse = np.divide(1.0, below, out=np.zeros_like(below), where=below > 1e-10 * np.maximum(unit, zz)[:, None])
        return a, my, zy[:, None] * inverse, inverse

    def one_by_one(self, v: np.ndarray, t: np.ndarray, fits: tuple[np.ndarray, ...], but: np.ndarray | None = None) -> np.ndarray:
        """(fits, alphas): errors over the rows (v, t); `but`: a row that a fit leaves out."""
        a, my, slope, inverse = fits
        d, out = 1 - 1 / (self.n - 1), np.zeros(slope.shape)
        for j in range(len(v)):
            w = np.where(np.isnan(v[j]), 0.0, v[j] - a)[:, None]
            left = d - w * w * inverse
            error = ((t[j] - my[:, None] - slope * w) / np.where(np.abs(left) > 1e-10, left, np.nan)) ** 2
            out += error if but is None else np.where((but == j)[:, None], 0.0, error)
        return out

    def by_moments(self, v: np.ndarray, t: np.ndarray, fits: tuple[np.ndarray, ...]) -> np.ndarray:
        """(fits, alphas): errors over the near rows but the own one, (v, t)."""
        a, my, slope, inverse = fits
        seen = ~np.isnan(v)
        x = np.where(seen, v, 0.0)
        left = np.stack([np.stack([self.near[p, q] - np.where(seen, x**p * t**q, 0.0) for q in range(3)]) for p in range(_TOP + 1)])
        left[:, 2] += -2 * my * left[:, 1] + my * my * left[:, 0]
        left[:, 1] -= my * left[:, 0]
        back = np.stack([(-a) ** p for p in range(_TOP + 1)])

        def moment(p: int, q: int) -> np.ndarray:
            return sum(comb(p, k) * back[p - k] * left[k, q] for k in range(p + 1))[:, None]

        d = 1 - 1 / (self.n - 1)
        gap = [self.gaps[q] - np.where(seen, 0.0, t**q) for q in range(3)]
        out = np.repeat(((gap[2] - 2 * my * gap[1] + my * my * gap[0]) / d**2)[:, None], len(self.alphas), axis=1)
        for k in range(POWERS + 1):
            out += (k + 1) * inverse**k / d ** (k + 2) * (moment(2 * k, 2) - 2 * slope * moment(2 * k + 1, 1) + slope * slope * moment(2 * k + 2, 0))
        return out

    def predicted(self, v: np.ndarray, fits: tuple[np.ndarray, ...]) -> np.ndarray:
        a, my, slope, _ = fits
        return self.middle + my[:, None] + slope * np.where(np.isnan(v), 0.0, v - a)[:, None]


def left_out(rows: DataFrame, who: str, target: str, column: str, groups: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """groups, who, true, pred of every row by the group's others, with their own scale and the alpha of least exact
    leave-one-out error among them. One row a group and person. A gap counts as the mean; null where under two others."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    cells = rows.select(*groups, who, number(target).alias("_y"), number(column).alias("_x")).where("_y is not null")
    keys = list(groups) or ["_all"]
    cells = cells if groups else cells.withColumn("_all", F.lit(0))
    frame = cells.groupBy(*keys).agg(F.count("_y").alias("_n"), F.avg("_y").alias("_my"), F.count("_x").alias("_c"), F.avg("_x").alias("_m"), F.when(F.var_pop("_x") > 0, F.var_pop("_x") * F.count("_x")).alias("_q"))
    placed = cells.join(frame, keys).withColumns({"_v": (F.col("_x") - F.col("_m")) / F.sqrt(F.coalesce("_q", F.lit(1.0))), "_t": F.col("_y") - F.col("_my")})
    placed = placed.withColumn("_odd", (F.col("_n") <= round(1 / FAR)) | F.coalesce(F.col("_v") * F.col("_v") > FAR, F.lit(False)))
    placed = keep(placed.withColumn("_chunk", F.pmod(F.xxhash64(who), F.ceil(F.col("_n") / CHUNK_ROWS))).select(*keys, who, "_y", "_v", "_t", "_odd", "_chunk"))

    def power(p: int, q: int):
        out = F.lit(1.0)
        for c in ["_v"] * p + ["_t"] * q:
            out = out * F.col(c)
        return out

    near, gap = ~F.col("_odd") & F.col("_v").isNotNull(), ~F.col("_odd") & F.col("_v").isNull()
    total = lambda rule, p, q: F.coalesce(F.sum(F.when(rule, power(p, q))), F.lit(0.0))
    sums = placed.groupBy(*keys).agg(
        F.array(*[total(near, p, q) for p in range(_TOP + 1) for q in range(3)]).alias("_near"), F.array(*[total(gap, 0, q) for q in range(3)]).alias("_gaps"),
        F.sort_array(F.collect_list(F.when(F.col("_odd"), F.struct(F.col(who).alias("_who"), "_y", "_v", "_t")))).alias("_far"),
    )
    state = frame.join(sums, keys).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / CHUNK_ROWS) - 1)))

    def solve(rows: pa.Table, held: pa.Table) -> pa.Table:
        row = held.slice(0, 1).to_pylist()[0]
        group = _Group(row, alphas)
        v, t = (rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in ("_v", "_t"))
        far = held["_far"].combine_chunks().flatten()[: len(group.v)]
        known = group.n > 2
        with np.errstate(all="ignore"):
            fits = group.others(v, t)
            preds = group.predicted(v, fits)
            if known and len(v):
                error = group.by_moments(v, t, fits) + group.one_by_one(group.v, group.t, fits)
                best = np.where(np.isfinite(error), error, np.inf).argmin(axis=1)
                pred = preds[np.arange(len(v)), best]
            else:
                pred = np.full(len(v), np.nan)
            fits = group.others(group.v, group.t)
            preds = group.predicted(group.v, fits)
            error = group.one_by_one(v, t, fits) if known else np.zeros(preds.shape)
            if known and row["_chunk"] == 0:
                error += group.one_by_one(group.v, group.t, fits, np.arange(len(group.v)))
            if not known:
                preds[:] = np.nan
        lists = lambda m: pa.array([[] for _ in range(len(v))] + m.tolist(), pa.list_(pa.float64()))
        pred = np.concatenate([pred, np.full(len(far), np.nan)])
        names = {k: pa.concat_arrays([rows[k].combine_chunks(), pa.array([row[k]] * len(far), rows.schema.field(k).type)]) for k in keys}
        return pa.table(names | {who: pa.concat_arrays([rows[who].combine_chunks(), far.field("_who").cast(rows.schema.field(who).type)]), "_odd": pa.array([False] * len(v) + [True] * len(far)), "true": pa.concat_arrays([rows["_y"].combine_chunks(), far.field("_y")]), "pred": pa.array(pred, pa.float64(), mask=np.isnan(pred)), "_errors": lists(error), "_preds": lists(preds)})

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, who]), "_odd boolean, true double, pred double, _errors array<double>, _preds array<double>"])
    near_rows = placed.where(~F.col("_odd")).select(*keys, who, "_y", "_v", "_t", "_chunk")
    found = keep(near_rows.groupBy(*keys, "_chunk").cogroup(state.groupBy(*keys, "_chunk")).applyInArrow(solve, schema))
    k = len(alphas)
    summed = found.where("_odd").groupBy(*keys, who).agg(F.first("true").alias("true"), F.array(*[F.sum(F.col("_errors")[a]) for a in range(k)]).alias("_e"), F.first("_preds").alias("_preds"))
    finite = F.transform("_e", lambda e: F.when(F.abs(e) < F.lit(float("inf")), e).otherwise(F.lit(float("inf"))))
    best = F.array_position(finite, F.array_min(finite)).cast("int")
    odd = summed.select(*groups, who, "true", F.nanvl(F.element_at("_preds", best), F.lit(None)).alias("pred"))
    return found.where("not _odd").select(*groups, who, "true", "pred").unionByName(odd)
