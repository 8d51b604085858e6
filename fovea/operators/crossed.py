"""Variances of people and items as crossed random effects (REML), from one pass of sums.

A person enters the equations by which cells they have and by the sum of their values, and their effect is eliminated
with a factor that depends on the number of their cells alone. So people with equally many cells are added up: one
matrix of items by items for each such number holds all that any round of the iteration needs, and the people, who
may be any number, are read once. Items are few enough for such a matrix (hundreds).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators.gram import _coded, summed

ROWS_AT_ONCE = 1000


def sums(cells: DataFrame, who: str, item: str, groups: Sequence[str] = (), fixed: str | None = None) -> DataFrame:
    """groups, _cells, _levels, _items, payload of cells with a `value`: sums over the people with so many cells."""

    def numbered(column: str, at: str, count: str) -> DataFrame:
        by = Window.partitionBy(*(groups or [F.lit(0)]))
        return cells.select(*groups, column).distinct().withColumns({at: F.row_number().over(by.orderBy(column)) - 1, count: F.count(F.lit(1)).over(by).cast("int")})

    rows = cells.join(numbered(item, "_i", "_items"), [*groups, item])
    rows = rows.join(numbered(fixed, "_f", "_levels"), [*groups, fixed]) if fixed else rows.withColumns({"_f": F.lit(0), "_levels": F.lit(1)})
    people = rows.groupBy(*groups, who).agg(F.first("_levels").alias("_levels"), F.first("_items").alias("_items"), F.collect_list("_f").alias("_f"), F.collect_list("_i").alias("_i"), F.collect_list(F.col("value").cast("double")).alias("_v"))
    fields = [f for f in people.schema.fields if f.name in groups]
    names = [*(f.name for f in fields), "_levels", "_items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            kinds = [batch.schema.field(n).type for n in names]
            col = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            own, code = _coded(batch, names)
            f, i, v = (col(n).flatten().to_numpy() for n in ("_f", "_i", "_v"))
            size = col("_v").value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            for c, key in enumerate(own):
                levels, items = key[-2:]
                for n in np.unique(size[code == c]):
                    mine = (code == c) & (size == n)
                    at = np.flatnonzero(mine[row])
                    place = (np.cumsum(mine) - 1)[row[at]]
                    found = _added(place, f[at], i[at], v[at], int(mine.sum()), levels, items)
                    held[(*key, int(n))] = held[(*key, int(n))] + found if (*key, int(n)) in held else found
        if held:
            columns = list(zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, [*kinds, pa.int32()], strict=True)), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=[*names, "_cells", "payload"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_levels int, _items int, _cells int, payload binary"])
    return summed(people.select(*names, "_f", "_i", "_v").mapInArrow(run, schema), [*names, "_cells"])


def _added(row: np.ndarray, f: np.ndarray, i: np.ndarray, v: np.ndarray, people: int, levels: int, items: int) -> np.ndarray:
    table = np.zeros((people, levels + items))
    np.add.at(table, (row, f), 1)
    np.add.at(table, (row, levels + i), 1)
    total = np.bincount(row, v, people)
    met = np.zeros((levels, items))
    np.add.at(met, (f, i), 1)
    return np.concatenate([[people, total @ total, v @ v], np.bincount(f, v, levels), np.bincount(i, v, items), met.ravel(), table.T @ total, (table.T @ table).ravel()])


def variances(parts: list[tuple[int, np.ndarray]], levels: int, items: int, random_items: bool = True, rounds: int = 300) -> tuple[float, float | None, float] | None:
    """Of people, items and error, by the mixed model equations in turn with their solution; None if undetermined.

    Fixed: an effect of each level and items random, or the items themselves (which hold what levels differ in).
    """
    size = levels + items
    cuts = np.cumsum([3, levels, items, levels * items, size])
    split = [(n, *np.split(p, cuts)) for n, p in parts]
    counts = np.array([n for n, *_ in split], float)
    people, square, energy = np.array([s[1] for s in split]).T
    y_level, y_item, met = sum(s[2] for s in split), sum(s[3] for s in split), sum(s[4] for s in split).reshape(levels, items)
    with_total, table = np.array([s[5] for s in split]), np.array([s[6].reshape(size, size) for s in split])
    n, yy = met.sum(), energy.sum()
    if people.sum() < 2 or items < 2 or n <= people.sum() + items:
        return None
    inner = np.zeros((size, size))
    inner[:levels, :levels], inner[levels:, levels:] = np.diag(met.sum(axis=1)), np.diag(met.sum(axis=0))
    inner[:levels, levels:], inner[levels:, :levels] = met, met.T
    by, fixed = np.concatenate([y_level, y_item]), levels
    if not random_items:
        inner, by, with_total, table, fixed = inner[levels:, levels:], y_item, with_total[:, levels:], table[:, levels:, levels:], items
    spread = yy / n - (y_item.sum() / n) ** 2
    if spread <= 0:
        return None
    va = vb = ve = spread / 3
    for _ in range(rounds):
        d = 1 / (counts + ve / va)
        once, twice = np.tensordot(d, table, 1), np.tensordot(d * d, table, 1)
        first, second = d @ with_total, (d * d) @ with_total
        penalty = np.diag(np.concatenate([np.zeros(fixed), np.full(len(by) - fixed, ve / vb)]))
        c = np.linalg.pinv(inner + penalty - once, hermitian=True) if not random_items else np.linalg.inv(inner + penalty - once)
        beta = c @ (by - first)
        effects = (d * d) @ square - 2 * beta @ second + beta @ twice @ beta
        trace = people @ d + (c * twice).sum()
        new = [(effects + ve * trace) / people.sum(), (beta[fixed:] @ beta[fixed:] + ve * np.trace(c[fixed:, fixed:])) / items if random_items else vb, (yy - beta @ by - (d @ square - beta @ first)) / (n - fixed)]
        new = [max(1e-12 * spread, x) for x in new]
        done = max(abs(a - b) for a, b in zip(new, (va, vb, ve), strict=True)) < 1e-10 * spread
        va, vb, ve = new
        if done:
            break
    return float(va), float(vb) if random_items else None, float(ve)


def solved(found: DataFrame, groups: Sequence[str], names: Sequence[str], answer) -> DataFrame:
    """groups and the numbers that `answer` makes of a group's parts, levels and items."""
    kept = [f for f in found.schema.fields if f.name in groups]

    def run(table: pa.Table) -> pa.Table:
        parts = [(n, np.frombuffer(p, np.float64)) for n, p in zip(table.column("_cells").to_pylist(), table.column("payload").to_pylist(), strict=True)]
        out = answer(sorted(parts, key=lambda p: p[0]), table.column("_levels")[0].as_py(), table.column("_items")[0].as_py())
        return pa.table({f.name: table.column(f.name).slice(0, 1) for f in kept} | {n: pa.array([v], pa.float64()) for n, v in zip(names, out, strict=True)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])
    return found.groupBy(*groups).applyInArrow(run, schema)
