"""Logistic and linear discriminant fits over folds, by rounds of sums: no group of rows meets in a task.

A system is a group and a fold; it learns from the group's rows outside the fold. Each round tells every task all
systems' parameters; tasks add up what their rows give (moments, gradient and Hessian, fourth moments), sums are added
where they stream in and the driver solves one small equation a system: (columns + 1)² numbers. Newton's method takes
some ten rounds over a kept table, the linear discriminant two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators.gram import _arrays, _cells, _coded, summed
from fovea.sources.shared import keep

ROUNDS = 100


@dataclass(frozen=True)
class Logistic:
    """`penalty`: share of the number of features as ridge penalty of each slope; `balanced`: classes weigh the same;
    `settles`: without convergence there is no fit."""

    penalty: float
    balanced: bool
    tolerance: float
    settles: bool


@dataclass
class Scale:
    """Training counts by class, means and spreads; gaps are 0 once scaled."""

    n: float
    ones: float
    mean: np.ndarray
    sd: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, k: int) -> Scale:
        n, ones = sums[:2]
        count, total, square = np.split(sums[2:], 3)
        mean = np.divide(total, count, out=np.zeros(k), where=count > 0)
        var = np.divide(square - mean * total, count - 1, out=np.zeros(k), where=count > 1)
        return cls(n, ones, mean, np.where(var > 1e-12 * np.maximum(1.0, mean * mean), np.sqrt(np.maximum(var, 0)), 1.0))

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean) / self.sd, nan=0, posinf=0, neginf=0)


def _finite(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = _arrays(batch, k)
    return np.where(np.isfinite(x), x, np.nan), y


def _added(rows: DataFrame, systems: dict[tuple, object], keys: Sequence[str], k: int, work: Callable[[np.ndarray, np.ndarray, object], np.ndarray]) -> dict[tuple, np.ndarray]:
    """For each system, the sum of `work` over its training rows: those of its groups whose fold (the last key) is another."""
    given, order = rows.sparkSession.sparkContext.broadcast(systems), list(systems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _finite(batch, k)
            own, code = _coded(batch, keys)
            for s, (key, held) in enumerate(given.value.items()):
                use = np.array([o[:-1] == key[:-1] and o[-1] != key[-1] for o in own], bool)[code] if own else []
                if np.any(use):
                    found = work(x[use], y[use], held)
                    total[s] = total[s] + found if s in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["system", "payload"])

    found = summed(rows.mapInArrow(run, "system int, payload binary"), ["system"]).collect()
    return {order[r["system"]]: np.frombuffer(r["payload"], np.float64) for r in found}


def _moments(x: np.ndarray, y: np.ndarray, _: object) -> np.ndarray:
    there, known = ~np.isnan(x), np.nan_to_num(x)
    return np.concatenate([[len(y), y.sum()], there.sum(axis=0), known.sum(axis=0), (known * known).sum(axis=0)])


def _with_one(z: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(z)), z])


def _newton(rows: DataFrame, scales: dict[tuple, Scale], keys: Sequence[str], k: int, how: Logistic) -> dict[tuple, np.ndarray]:
    penalty = np.diag([0.0] + [how.penalty * k] * k)

    def work(x: np.ndarray, y: np.ndarray, held: tuple[Scale, np.ndarray]) -> np.ndarray:
        scale, w = held
        z = _with_one(scale.z(x))
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        weight = np.where(y == 1, scale.n / (2 * scale.ones), scale.n / (2 * (scale.n - scale.ones))) if how.balanced else np.ones(len(y))
        return np.concatenate([z.T @ (weight * (y - p)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

    w = {key: np.zeros(k + 1) for key in scales}
    done: dict[tuple, np.ndarray] = {}
    for _ in range(ROUNDS):
        active = {key: (scales[key], w[key]) for key in w}
        if not active:
            break
        for key, sums in _added(rows, active, keys, k, work).items():
            hessian = sums[k + 1 :].reshape(k + 1, k + 1) + penalty
            if how.settles and np.linalg.matrix_rank(hessian) <= k:
                del w[key]  # separated or undetermined
                continue
            step = np.linalg.lstsq(hessian, sums[: k + 1] - penalty @ w[key], rcond=None)[0]
            w[key] = w[key] + step
            if not np.isfinite(w[key]).all():
                del w[key]
            elif np.abs(step).max() < how.tolerance:
                done[key] = w.pop(key)
    return done if how.settles else done | w


def _linear(rows: DataFrame, scales: dict[tuple, Scale], keys: Sequence[str], k: int) -> dict[tuple, np.ndarray]:
    """The pooled covariance shrinks to its mean variance by the Ledoit-Wolf share, whose noise is the sum of squared
    row norms over the rows less the squared covariance."""

    def second(x: np.ndarray, y: np.ndarray, scale: Scale) -> np.ndarray:
        z = scale.z(x)
        return np.concatenate([z[y == 1].sum(axis=0), z[y == 0].sum(axis=0), (z.T @ z).ravel()])

    def fourth(x: np.ndarray, y: np.ndarray, held: tuple[Scale, np.ndarray, np.ndarray]) -> np.ndarray:
        scale, a, b = held
        c = scale.z(x) - np.where(y[:, None] == 1, a, b)
        return np.array([((c * c).sum(axis=1) ** 2).sum()])

    middles, covariance, out = {}, {}, {}
    for key, sums in _added(rows, scales, keys, k, second).items():
        scale = scales[key]
        n1, n0 = scale.ones, scale.n - scale.ones
        a, b = sums[:k] / n1, sums[k : 2 * k] / n0
        middles[key] = (scale, a, b)
        covariance[key] = (sums[2 * k :].reshape(k, k) - n1 * np.outer(a, a) - n0 * np.outer(b, b)) / scale.n
    for key, sums in _added(rows, middles, keys, k, fourth).items():
        scale, a, b = middles[key]
        s = covariance[key]
        mu = np.trace(s) / k
        spread = ((s - mu * np.eye(k)) ** 2).sum() / k
        noise = (sums[0] / scale.n - (s * s).sum()) / scale.n / k
        shrink = min(1.0, noise / spread) if spread > 0 else 1.0
        w = np.linalg.lstsq((1 - shrink) * s + shrink * mu * np.eye(k), a - b, rcond=None)[0]
        share = scale.ones / scale.n
        out[key] = np.concatenate([[-(a + b) @ w / 2 + np.log(share / (1 - share))], w])
    return out


#: C = 1 / p with balanced classes; the pooled discriminant; maximum likelihood, which may not exist.
FITS: dict[str, Callable[..., dict[tuple, np.ndarray]]] = {
    "logistic": lambda *a: _newton(*a, Logistic(1.0, True, 1e-8, False)),
    "lda": _linear,
    "plain_logistic": lambda *a: _newton(*a, Logistic(0.0, False, 1e-9, True)),
}


def scores(train: DataFrame, test: DataFrame, who: str, native: str, fold: str, columns: Sequence[str], groups: Sequence[str] = (), how: str = "logistic") -> DataFrame:
    """groups, who, eye_score of the test rows: log-odds of being native by a fit on the training rows of their group whose
    fold is another. Null where the fit has one class or doesn't exist. Columns are standardised in each fit."""
    k, keys = len(columns), [*groups, fold]
    rows = keep(_cells(train, keys, native, columns).where("_y is not null"))
    systems = dict.fromkeys(tuple(r) for r in test.select(*keys).distinct().collect())
    scales = {key: Scale.of(sums, k) for key, sums in _added(rows, systems, keys, k, _moments).items()}
    scales = {key: s for key, s in scales.items() if 0 < s.ones < s.n}
    fits = FITS[how](rows, scales, keys, k) if scales else {}
    given = train.sparkSession.sparkContext.broadcast({key: (scales[key], w) for key, w in fits.items()})
    kept = [f for f in test.schema.fields if f.name in {*groups, who}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _finite(batch, k)
            out = np.full(batch.num_rows, np.nan)
            own, code = _coded(batch, keys)
            for c, key in enumerate(own):
                if key in given.value:
                    scale, w = given.value[key]
                    at = np.flatnonzero(code == c)
                    out[at] = _with_one(scale.z(x[at])) @ w
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(out, pa.float64(), mask=np.isnan(out))], names=[*(f.name for f in kept), "eye_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "eye_score double"])
    names = list(dict.fromkeys([*keys, who]))
    cells = _cells(test.withColumn("_none", F.lit(0.0)), names, "_none", columns)
    return cells.mapInArrow(run, schema).select(*groups, who, "eye_score")
