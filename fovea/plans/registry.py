"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows where there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = prefix + sql
        return fn

    return add


def rounded(c: str | Column, digits: int = 6) -> Column:
    """For comparison: rounded, without a negative zero. At 4 digits a little is added first, so that means of
    cents over 2, 4, 8 or 16 rows don't fall on a rounding edge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3e-6) if digits == 4 else c, digits) + F.lit(0.0)


def rounded_all(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def least_squares(rows: str, keys: str, y: str, xs: list[str], name: str = "ls") -> str:
    """CTEs that fit y on xs with an intercept for each of `keys` in relation `rows`: relation `name` has keys, n, b_0,
    b_1 ... and `rank`, the least pivot as a share of its column's spread. Gaussian elimination of the centred sums."""
    k = len(xs)
    key = f"{keys}, " if keys else ""
    cells = [f"covar_pop({xs[i]}, {xs[j]}) * count(*) AS a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"covar_pop({xs[i]}, {y}) * count(*) AS r{i}" for i in range(k)]
    steps = [f"{name}_0 AS (SELECT {key}count(*) AS n, avg({y}) AS my, {', '.join(f'avg({x}) AS m{i}, var_pop({x}) * count(*) AS d{i}' for i, x in enumerate(xs))}, {', '.join(cells)} FROM {rows}{f' GROUP BY {keys}' if keys else ''})"]
    for j in range(k - 1):
        new = [f"a{i}_{c} - a{j}_{i} * a{j}_{c} / a{j}_{j} AS a{i}_{c}" for i in range(j + 1, k) for c in range(i, k)] + [f"r{i} - a{j}_{i} * r{j} / a{j}_{j} AS r{i}" for i in range(j + 1, k)]
        steps.append(f"{name}_{j + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{j})")
    last = f"{name}_{k - 1}"
    for i in reversed(range(k)):
        rest = "".join(f" - a{i}_{c} * b_{c + 1}" for c in range(i + 1, k))
        steps.append(f"{name}_b{i} AS (SELECT *, (r{i}{rest}) / a{i}_{i} AS b_{i + 1} FROM {last})")
        last = f"{name}_b{i}"
    steps.append(f"{name} AS (SELECT {key}n, my{''.join(f' - b_{i + 1} * m{i}' for i in range(k))} AS b_0, {', '.join(f'b_{i + 1}' for i in range(k))}, least({', '.join(f'a{i}_{i} / nullif(d{i}, 0)' for i in range(k))}) AS rank FROM {last})")
    return ", ".join(steps)
