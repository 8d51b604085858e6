"""Bootstraps as grouped sums: a row's weight in a draw is a Poisson number hashed from the row's key and the draw.

Rows needn't meet: each task adds up its rows' weighted terms for all draws, sums are added where they stream in, and
a cell of a result table is finished from one number a term and draw. Weights of one row are the same wherever the
row is, so a lost task gives the same sums again, and one person's weight is the same in every cell.

The Poisson numbers have mean 1, as counts of a resample have; they come from 16 bits each, so their shares are exact
to 2 ** -16. The number of rows in a draw varies with them. Column 0 of the sums has weight 1: the data as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators.gram import _coded, summed

DRAWS_A_BLOCK = 1000
ROWS_AT_ONCE = 100
HELD_BYTES = 256_000_000
#: Weights that a task draws at most, where there are more than cores can share.
WEIGHTS_A_TASK = 2_000_000_000


def _poisson_table() -> np.ndarray:
    """For each 16-bit number, the Poisson number (mean 1) at that share."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float64)


#: The 16-bit numbers from which on the Poisson number is one more.
_EDGES = [np.uint16(e) for e in np.flatnonzero(np.diff(_poisson_table())) + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """In place, but for the first step."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(keys: np.ndarray, first: int, draws: int, seed: int = 42) -> np.ndarray:
    """(rows, draws) Poisson numbers of the draws `first` (a multiple of four) on, by the rows' 64-bit keys."""
    quarter = np.arange(first // 4, -(-(first + draws) // 4), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = _mixed(_mixed(keys.astype(np.uint64) + np.uint64(seed))[:, None] + quarter[None, :]).view(np.uint16)
    out = np.zeros(bits.shape, np.uint8)
    for edge in _EDGES:  # comparisons run on many 16-bit numbers at once, a look-up on one
        out += (bits >= edge).view(np.uint8)
    return out[:, :draws].astype(np.float64)


def row_key(groups: Sequence[str], values: Sequence[str], who: str | None) -> Column:
    """A row's identity: its person, or its values and which of its equals it is."""
    if who:
        return F.xxhash64(who)
    return F.xxhash64(*values, F.row_number().over(Window.partitionBy(*groups, *values).orderBy(F.lit(0))))


def weighted_sums(df: DataFrame, groups: Sequence[str], key: Column, terms: Sequence[Column], draws: int, seed: int = 42) -> DataFrame:
    """groups, block, payload: the terms' sums under the weights of a block of draws, (terms, draws) in float64."""
    k = len(terms)
    fields = [f for f in df.schema.fields if f.name in groups]
    names = [f.name for f in fields]
    starts = list(range(0, draws, DRAWS_A_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def flushed(*which: tuple) -> Iterator[pa.RecordBatch]:
            for own in which or list(held):
                blocks = held.pop(own)
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(blocks), t) for v, t in zip(own, kinds, strict=True)), pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=[*names, "block", "payload"])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            found, code = _coded(batch, names)
            keys = batch.column(batch.schema.get_field_index("_key")).to_numpy().view(np.uint64)
            x = batch.column(batch.schema.get_field_index("_terms")).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for c, own in enumerate(found):
                if own not in held:
                    if (len(held) + 1) * 8 * k * (draws + 1) > HELD_BYTES:
                        yield from flushed()
                    held[own] = [np.zeros((k, 1)), *(np.zeros((k, min(DRAWS_A_BLOCK, draws - s))) for s in starts)]
                rows = np.flatnonzero(code == c)
                held[own][0] += x[rows].sum(axis=0)[:, None]
                for at in (rows[i : i + ROWS_AT_ONCE] for i in range(0, len(rows), ROWS_AT_ONCE)):
                    for total, s in zip(held[own][1:], starts, strict=True):
                        total += x[at].T @ weights(keys[at], s, total.shape[1], seed)
            for own in [own for own in held if own != found[-1]]:  # rows come sorted
                yield from flushed(own)
        yield from flushed()

    rows = df.select(*names, key.alias("_key"), F.array(*[t.cast("double") for t in terms]).alias("_terms"))
    # a task's time is that of its weights, so rows are dealt by how many there are, not as they lie
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * draws // WEIGHTS_A_TASK))
    rows = rows.repartition(tasks, "_key").sortWithinPartitions(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "block int, payload binary"])
    return summed(rows.mapInArrow(run, schema), [*names, "block"])


def finished(sums: DataFrame, groups: Sequence[str], terms: int, inner: Sequence[str], names: Sequence[str], finish: Callable[[np.ndarray], list]) -> DataFrame:
    """groups and the numbers (n first) that `finish` makes of (inner keys, terms, 1 + draws) sums; a task has one cell's sums."""
    kept = [f for f in sums.schema.fields if f.name in groups]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*inner, "block")])
        parts = [np.frombuffer(p, np.float64).reshape(terms, -1) for p in table.column("payload").to_pylist()]
        blocks = max(table.column("block").to_pylist()) + 1
        held = np.stack([np.concatenate(parts[i : i + blocks], axis=1) for i in range(0, len(parts), blocks)])
        out = finish(held)
        columns = {f.name: table.column(f.name).slice(0, 1) for f in kept}
        return pa.table(columns | {n: pa.array([None if v is None or not np.isfinite(v) else v], pa.int64() if n == "n" else pa.float64()) for n, v in zip(names, out, strict=True)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {'long' if n == 'n' else 'double'}" for n in names)])
    return sums.groupBy(*groups).applyInArrow(run, schema)


def correlation(n: np.ndarray, x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """From weighted sums; NaN where a side doesn't vary."""
    with np.errstate(all="ignore"):
        vx, vy = xx - x * x / n, yy - y * y / n
        out = (xy - x * y / n) / np.sqrt(vx * vy)
        return np.where((vx > 1e-12 * xx) & (vy > 1e-12 * yy), out, np.nan)


def centred(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns less their group's mean, as `_c_` columns: small numbers add up exactly enough."""
    means = df.groupBy(*groups).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(means, list(groups)) if groups else df.crossJoin(F.broadcast(means))
    return joined.withColumns({f"_c_{c}": F.col(c).cast("double") - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def interval(draws: np.ndarray) -> list[float | None]:
    """Mean, standard deviation and percentiles 2.5 and 97.5 of the draws that have a value."""
    draws = draws[np.isfinite(draws)]
    return [draws.mean(), draws.std(ddof=1), *np.percentile(draws, [2.5, 97.5])] if len(draws) > 1 else [None] * 4


def usable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all there and finite."""
    rule = F.lit(True)
    for c in columns:
        rule = rule & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    return df.where(rule)
