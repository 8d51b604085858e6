"""Tail probabilities. The normal one is a column expression; t and F go through the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + term / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _each(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([fn(*map(float, row)) if all(v is not None and np.isfinite(v) for v in row) else None for row in zip(*columns, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _each(f_upper, f, df1, df2)


@pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided, z)


def correlation_t(r: Column, n: Column) -> Column:
    """t of a correlation, null when it isn't determined."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
