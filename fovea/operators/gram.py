"""Least squares and ridge on many columns from sums of products, added up in packed blocks.

Each task adds up its rows' products in numpy, a matrix for each key (a fold, an item), and sends them as blocks of
BLOCK x BLOCK columns. Blocks are added up where they stream in, so the plan doesn't grow with the columns and no
task holds more than one key's block beside its own rows' sums. Whatever leaves rows out (folds, items, halves) is
the total less the own sums, block by block. A key's blocks make one system, decomposed once; the decomposition then
serves every penalty: with rows rotated by it, fits and leverages of all penalties are one product each.

A gap counts as the column's mean: the sums over pairs of cells that are both there say how that mean enters. One
key's sums must fit a task: about 3000 columns. Beyond that `kernel` goes by people instead of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.sources.shared import keep

BLOCK = 64
HELD_BYTES = 256_000_000
SHARED_BYTES = 256_000_000
_HEAD = -1  # the block of what isn't a pair of columns


def summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: the sum of its `payload` vectors (float64 bytes), added up as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, kinds = None, None, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for key, raw in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("payload"), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.float64)
                if key == last:
                    total += values
                    continue
                if last is not None:
                    yield _row(keys, kinds, last, total)
                last, total = key, values.copy()
        if last is not None:
            yield _row(keys, kinds, last, total)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in keys]
    dealt = parts.select(*keys, "payload").repartition(*keys).sortWithinPartitions(*keys)
    order = [k for k in parts.columns if k in keys]
    return dealt.select(*order, "payload").mapInArrow(run, ", ".join([*kept, "payload binary"]))


def _row(keys: Sequence[str], kinds: Sequence[pa.DataType], key: tuple, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, kinds, strict=True)), pa.array([values.tobytes()], pa.binary())], names=[*keys, "payload"])


# -- sums of products --------------------------------------------------------------------------------------------------


@dataclass
class Sums:
    """Over a key's rows: n, sums of y and y²; by column x'y and the y's where x is there; by pair of columns, over rows
    where both are there, their number, the sum of the first and of the product."""

    head: np.ndarray  # n, y, yy
    xy: np.ndarray
    yn: np.ndarray
    count: np.ndarray
    first: np.ndarray
    product: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Sums:
        return cls(np.zeros(3), np.zeros(k), np.zeros(k), *(np.zeros((k, k)) for _ in range(3)))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        there = ~np.isnan(x)
        self.head += (len(y), y.sum(), y @ y)
        if there.all():
            self.xy += x.T @ y
            self.yn += y.sum()
            self.count += len(y)
            self.first += x.sum(axis=0)[:, None]
            self.product += x.T @ x
        else:
            x, there = np.where(there, x, 0), there.astype(float)
            self.xy += x.T @ y
            self.yn += there.T @ y
            self.count += there.T @ there
            self.first += x.T @ there
            self.product += x.T @ x

    def with_other(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))

    def packed(self) -> Iterator[tuple[int, int, np.ndarray]]:
        yield _HEAD, _HEAD, np.concatenate([self.head, self.xy, self.yn])
        for i, j in _pairs(len(self.xy)):
            a, b = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
            yield i, j, np.concatenate([self.count[a, b].ravel(), self.first[a, b].ravel(), self.first[b, a].ravel(), self.product[a, b].ravel()])

    @classmethod
    def unpacked(cls, k: int, blocks: Iterator[tuple[int, int, bytes]]) -> Sums:
        out = cls.empty(k)
        for i, j, raw in blocks:
            v = np.frombuffer(raw, np.float64)
            if i == _HEAD:
                out.head, out.xy, out.yn = v[:3], v[3 : 3 + k], v[3 + k :]
                continue
            a, b = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
            p, q = min(k, a.stop) - a.start, min(k, b.stop) - b.start
            count, first, back, product = np.split(v, 4)
            out.count[a, b], out.first[a, b], out.first[b, a], out.product[a, b] = count.reshape(p, q), first.reshape(p, q), back.reshape(q, p), product.reshape(p, q)
            out.count[b, a], out.product[b, a] = out.count[a, b].T, out.product[a, b].T
        return out


def _pairs(k: int) -> list[tuple[int, int]]:
    n = -(-k // BLOCK)
    return [(i, j) for i in range(n) for j in range(i, n)]


def _cells(df: DataFrame, fields: Sequence[str], target: str, columns: Sequence[str]) -> DataFrame:
    x = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns])
    return df.select(*fields, F.nanvl(F.col(target).cast("double"), F.lit(None)).alias("_y"), x.alias("_x"))


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return x.reshape(-1, k), batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(float, copy=False)


def _coded(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[list[tuple], np.ndarray]:
    """The batch's distinct keys and each row's place among them."""
    if not keys:
        return [()], np.zeros(batch.num_rows, int)
    at: dict[tuple, int] = {}
    code = [at.setdefault(key, len(at)) for key in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)]
    return list(at), np.array(code, int)


def sums_by(rows: DataFrame, keys: Sequence[str], target: str, columns: Sequence[str]) -> DataFrame:
    """keys, i, j, payload: blocks of each key's Sums over the rows that have a target."""
    k, size = len(columns), 8 * (3 * len(columns) ** 2 + 2 * len(columns) + 3)
    fields = [f for f in rows.schema.fields if f.name in keys]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sums] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                i, j, payload = zip(*sums.packed(), strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(i), t) for v, t in zip(key, kinds, strict=True)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([p.tobytes() for p in payload], pa.binary())], names=[*names, "i", "j", "payload"])
            held.clear()

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            x, y = _arrays(batch, k)
            found, code = _coded(batch, names)
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(found) + 1))
            for c, key in enumerate(found):
                at = order[ends[c] : ends[c + 1]]
                if key not in held and (len(held) + 1) * size > HELD_BYTES:
                    yield from flushed()
                held.setdefault(key, Sums.empty(k)).add(x[at], y[at])
        yield from flushed()

    cells = _cells(rows, names, target, columns).where("_y is not null")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "i int, j int, payload binary"])
    return summed(cells.mapInArrow(run, schema), [*names, "i", "j"])


def outside(own: DataFrame, groups: Sequence[str], apart: Sequence[str]) -> DataFrame:
    """own's keys with the sums over the rows of the same groups that differ in every one of the one or two `apart` columns."""
    fields = [f for f in own.schema.fields if f.name in (*groups, *apart)]

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.float64) for p in table.column("payload").to_pylist()]
        keys = list(zip(*(table.column(c).to_pylist() for c in apart), strict=True))
        total = np.sum(parts, axis=0)
        if len(apart) == 1:
            left = [total - p for p in parts]
        else:
            by: tuple[dict, dict] = ({}, {})
            for key, p in zip(keys, parts, strict=True):
                for side in (0, 1):
                    by[side][key[side]] = by[side].get(key[side], 0) + p
            left = [total - by[0][a] - by[1][b] + p for (a, b), p in zip(keys, parts, strict=True)]
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array([v.tobytes() for v in left], pa.binary()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "i int, j int, payload binary"])
    return own.select(*[f.name for f in fields], "i", "j", "payload").groupBy(*groups, "i", "j").applyInArrow(run, schema)


# -- systems -----------------------------------------------------------------------------------------------------------


@dataclass
class System:
    """Scaled and centred normal equations, decomposed: rows rotated by `vectors` have uncorrelated columns."""

    n: float
    middle: float  # mean target
    mean: np.ndarray
    sd: np.ndarray
    shift: np.ndarray  # mean of the scaled columns whose gaps are 0
    values: np.ndarray
    along: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, sums: Sums, scale: Sums | None = None) -> System:
        """`scale`: the sums that mean and spread come from, if others than those fitted."""
        base = scale or sums
        count, total = np.diag(base.count), np.diag(base.first)
        k = len(total)
        mean = np.divide(total, count, out=np.zeros(k), where=count > 0)
        var = np.divide(np.diag(base.product) - mean * total, count - 1, out=np.zeros(k), where=count > 1)
        sd = np.where(var > 1e-12 * np.maximum(1.0, mean * mean), np.sqrt(np.maximum(var, 0)), 1.0)
        n, y, _ = sums.head
        middle = y / n if n else 0.0
        shift = (np.diag(sums.first) - mean * np.diag(sums.count)) / sd / max(n, 1)
        square = (sums.product - mean[None, :] * sums.first - mean[:, None] * sums.first.T + np.outer(mean, mean) * sums.count) / np.outer(sd, sd) - n * np.outer(shift, shift)
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        with_y = (sums.xy - mean * sums.yn) / sd - shift * y
        return cls(n, middle, mean, sd, shift, np.maximum(values, 0), vectors.T @ with_y, vectors)

    def dumps(self) -> bytes:
        return np.concatenate([[self.n, self.middle], self.mean, self.sd, self.shift, self.values, self.along, self.vectors.ravel()]).tobytes()

    @classmethod
    def loads(cls, raw: bytes, k: int) -> System:
        v = np.frombuffer(raw, np.float64)
        return cls(v[0], v[1], *np.split(v[2 : 2 + 5 * k], 5), v[2 + 5 * k :].reshape(k, k))

    @property
    def singular(self) -> bool:
        return self.n <= len(self.values) or bool(self.values.min(initial=np.inf) <= 1e-10 * max(1.0, self.values.max(initial=0)))

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (np.nan_to_num((x - self.mean) / self.sd, nan=0, posinf=0, neginf=0) - self.shift) @ self.vectors

    def inverse(self, alphas: Sequence[float]) -> np.ndarray:
        """(columns, alphas): 1 / (value + alpha); 0 for what the rows don't determine."""
        below = self.values[:, None] + np.asarray(alphas, float)[None, :]
        return np.divide(1.0, below, out=np.zeros_like(below), where=below > 1e-10 * max(1.0, self.values.max(initial=0)))

    def fitted(self, turned: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
        return self.middle + turned @ (self.along[:, None] * self.inverse(alphas))

    def left_out(self, turned: np.ndarray, y: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
        """(rows, alphas): prediction of each of the system's rows by all its others. NaN where a row decides its own fit."""
        left = 1 - 1 / self.n - (turned * turned) @ self.inverse(alphas)
        return y[:, None] - (y[:, None] - self.fitted(turned, alphas)) / np.where(np.abs(left) > 1e-10, left, np.nan)


def systems(blocks: DataFrame, keys: Sequence[str], k: int, least: int = 2) -> DataFrame:
    """keys, system of every key with `least` rows."""
    fields = [f for f in blocks.schema.fields if f.name in keys]
    names = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        sums = Sums.unpacked(k, zip(*(table.column(c).to_pylist() for c in ("i", "j", "payload")), strict=True))
        held = [System.of(sums).dumps()] if sums.head[0] >= least else []
        return pa.table({n: table.column(n).slice(0, len(held)) for n in names} | {"system": pa.array(held, pa.binary())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "system binary"])
    return blocks.groupBy(*names).applyInArrow(run, schema)


def shared(found: DataFrame, keys: Sequence[str], k: int, *more: str) -> Iterator[dict[tuple, list[System]]]:
    """The kept systems (and those of the columns `more`) in slices of SHARED_BYTES at most, or one key, to go to every task."""
    names = list(dict.fromkeys(["system", *more]))
    total = found.count() * len(names) * 8 * (k * k + 5 * k + 2)
    slices = max(1, -(-total // SHARED_BYTES))
    at = F.pmod(F.xxhash64(*keys), F.lit(slices)) if keys else F.lit(0)
    for s in range(slices):
        yield {tuple(r[c] for c in keys): [System.loads(r[n], k) for n in names] for r in found.where(at == s).collect()}


def best_alphas(rows: DataFrame, found: dict[tuple, System], groups: Sequence[str], apart: Sequence[str], target: str, columns: Sequence[str], alphas: Sequence[float]) -> dict[tuple, float]:
    """The penalty of least exact leave-one-out error for each system, keyed by groups and apart, whose rows are those of
    its groups that differ in all of `apart`. Tasks add up their rows' errors."""
    k, names, number = len(columns), [*groups, *apart], {key: n for n, key in enumerate(found)}
    given = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), len(alphas)))
        for batch in batches:
            x, y = _arrays(batch, k)
            own, code = _coded(batch, names)
            for key, system in given.value.items():
                g = len(groups)
                fits = np.array([o[:g] == key[:g] and all(a != b for a, b in zip(o[g:], key[g:], strict=True)) for o in own], bool)
                use = fits[code] if len(own) else np.zeros(0, bool)
                if use.any():
                    off = y[use, None] - system.left_out(system.rotated(x[use]), y[use], alphas)
                    total[number[key]] += (off * off).sum(axis=0)
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["system", "alpha", "error"])

    cells = _cells(rows, names, target, columns).where("_y is not null").mapInArrow(run, "system long, alpha long, error double")
    errors = np.full((len(number), len(alphas)), np.inf)
    for s, a, e in cells.groupBy("system", "alpha").agg(F.sum("error")).collect():
        errors[s, a] = e if np.isfinite(e) else np.inf
    return {key: float(alphas[int(np.argmin(errors[n]))]) for key, n in number.items()}


def _predictions(test: DataFrame, fits: dict[tuple, tuple[System, float]], others: set[tuple] | None, keys: Sequence[str], who: str, target: str, columns: Sequence[str], left_out: bool, strict: bool) -> DataFrame:
    """The test rows whose key has a system here; with `others`, those of no system at all too (keys outside that set)."""
    k = len(columns)
    given = test.sparkSession.sparkContext.broadcast((fits, others))
    kept = [f for f in test.schema.fields if f.name in {*keys, who}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = given.value
        for batch in batches:
            x, y = _arrays(batch, k)
            pred, here = np.full(len(y), np.nan), np.zeros(len(y), bool)
            own, code = _coded(batch, keys)
            for c, key in enumerate(own):
                at = np.flatnonzero(code == c)
                here[at] = key in held or (known is not None and key not in known)
                system, alpha = held.get(key, (None, 0.0))
                if system and not (strict and system.singular):
                    turned = system.rotated(x[at])
                    pred[at] = (system.left_out(turned, y[at], [alpha]) if left_out else system.fitted(turned, [alpha]))[:, 0]
            there = pa.array(here)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            pair = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (y, pred)]
            yield pa.RecordBatch.from_arrays([v.filter(there) for v in (*arrays, *pair)], names=[*(f.name for f in kept), "true", "pred"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "true double, pred double"])
    return _cells(test, [f.name for f in kept], target, columns).mapInArrow(run, schema)


def _answered(found: DataFrame, test: DataFrame, keys: Sequence[str], who: str, target: str, columns: Sequence[str], left_out: bool, strict: bool, chosen: Callable[[dict], dict], used: str = "system") -> DataFrame:
    """Predictions of all test rows, a slice of the systems at a time; `chosen` tells a slice's penalties."""
    k, out = len(columns), None
    every = {tuple(r) for r in found.select(*keys).collect()} if keys else {()} if found.count() else set()
    names = list(dict.fromkeys([*keys, who]))
    for part in shared(found, keys, k, used):
        alpha = chosen({key: held[0] for key, held in part.items()})
        one = _predictions(test, {key: (held[-1], alpha[key]) for key, held in part.items()}, every if out is None else None, keys, who, target, columns, left_out, strict)
        out = one if out is None else out.unionByName(one)
    return out.select(*names, "true", "pred")


def predicted(rows: DataFrame, test: DataFrame, who: str, target: str, columns: Sequence[str], groups: Sequence[str] = (), apart: Sequence[str] = (), alphas: Sequence[float] = (0.0,), left_out: bool = False, strict: bool = False, sums: Callable[..., DataFrame] | None = None) -> DataFrame:
    """groups, apart, who, true, pred of all test rows.

    A test row is predicted from the rows of its groups that differ from it in every `apart` column (one or two), by
    ridge with the alpha of least exact leave-one-out error among them; alpha 0 is least squares. `left_out`: from all
    other rows of its groups instead. `strict`: null where the system is singular, else the least solution. Without
    two rows to learn from, pred is null. `sums` replaces `sums_by`, such as a store's.
    """
    keys, k = [*groups, *apart], len(columns)
    own = (sums or sums_by)(rows, keys, target, columns)
    if apart:
        own = outside(keep(own), groups, apart)
    found = keep(systems(own, keys, k))

    def chosen(part: dict[tuple, System]) -> dict[tuple, float]:
        return best_alphas(rows, part, groups, apart, target, columns, alphas) if len(alphas) > 1 else dict.fromkeys(part, alphas[0])

    return _answered(found, test, keys, who, target, columns, left_out, strict, chosen)


def crossfitted(rows: DataFrame, who: str, target: str, columns: Sequence[str], groups: Sequence[str], half: str, alphas: Sequence[float], least: int = 3) -> DataFrame:
    """groups, half, who, true, pred: each row by all others of its groups, with the scale and the alpha of the other half."""
    keys, k = [*groups, half], len(columns)
    own = keep(sums_by(rows, keys, target, columns))
    fields = [f for f in own.schema.fields if f.name in keys]

    def build(table: pa.Table) -> pa.Table:
        side = table.column(half).to_pylist()
        by = {h: Sums.unpacked(k, ((i, j, p) for s, i, j, p in zip(side, *(table.column(c).to_pylist() for c in ("i", "j", "payload")), strict=True) if s == h)) for h in dict.fromkeys(side)}
        held = [(h, by[1 - h], by[h].with_other(by[1 - h])) for h in by if 1 - h in by and by[1 - h].head[0] >= least]
        columns = {f.name: pa.array([h for h, *_ in held] if f.name == half else [table.column(f.name)[0].as_py()] * len(held), table.schema.field(f.name).type) for f in fields}
        return pa.table(columns | {"system": pa.array([System.of(o).dumps() for _, o, _ in held], pa.binary()), "whole": pa.array([System.of(b, o).dumps() for _, o, b in held], pa.binary())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "system binary, whole binary"])
    found = keep(own.groupBy(*groups).applyInArrow(build, schema))
    return _answered(found, rows, keys, who, target, columns, True, False, lambda part: best_alphas(rows, part, groups, [half], target, columns, alphas), "whole")
