"""Composite language distances over a table (iso, component, distance), named by a small expression.

'a+b' is the mean of raw components; a prefix scales each first: 'z:' standardises, 'z01:' maps z to 0..1 by its own
range, 'z2sd:' clips z at two deviations and maps to 0..1, 'sd:' divides by the deviation, 'mm:' maps by range,
'max:' divides by the largest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = ("z", "z01", "z2sd", "sd", "mm", "max")


def parse(kind: str) -> tuple[str | None, list[str]]:
    scale, _, rest = kind.rpartition(":")
    if scale and scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}")
    parts = [p.strip() for p in rest.split("+")]
    if not all(parts):
        raise ValueError(f"empty component in {kind!r}")
    return scale or None, parts


def references(table: DataFrame) -> DataFrame:
    """component, mean, sd (of the population), low, high over the shared languages."""
    return table.groupBy("component").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"), F.min("distance").alias("low"), F.max("distance").alias("high"))


def _scaled(scale: str | None) -> Column:
    d, z = F.col("distance"), F.try_divide(F.col("distance") - F.col("mean"), F.col("sd"))
    by_range = F.try_divide(d - F.col("low"), F.col("high") - F.col("low"))
    z_low, z_high = F.try_divide(F.col("low") - F.col("mean"), F.col("sd")), F.try_divide(F.col("high") - F.col("mean"), F.col("sd"))
    return {
        None: d,
        "z": z,
        "z01": F.try_divide(z - z_low, z_high - z_low),
        "z2sd": (F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) + 2) / 4,
        "sd": F.try_divide(d, F.col("sd")),
        "mm": F.greatest(F.lit(0.0), F.least(F.lit(1.0), by_range)),
        "max": F.try_divide(d, F.col("high")),
    }[scale]


def distance(table: DataFrame, kind: str, iso: str = "iso") -> DataFrame:
    """iso, distance: the mean over the components a language has; null if it has none of them."""
    scale, parts = parse(kind)
    joined = table.where(F.col("component").isin(parts)).join(F.broadcast(references(table)), "component")
    return joined.groupBy(iso).agg(F.avg(_scaled(scale)).alias("distance"))


def angular(vectors: DataFrame, base: str, iso: str = "iso") -> DataFrame:
    """iso, distance: angle between a language's features and the base's over features both know. vectors: iso, feature, value."""
    mine = vectors.where(F.col(iso) == base).select("feature", F.col("value").alias("b"))
    sums = vectors.join(F.broadcast(mine), "feature").where("value is not null and b is not null").groupBy(iso).agg(F.sum(F.col("value") * F.col("b")).alias("vb"), F.sqrt(F.sum(F.col("value") * F.col("value")) * F.sum(F.col("b") * F.col("b"))).alias("norm"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("vb"), F.when(F.col("norm") > 0, F.col("norm")))))
    return sums.select(iso, (2 * F.acos(cos) / F.pi()).alias("distance"))


def merged_sources(sources: DataFrame, how: str = "union", iso: str = "iso") -> DataFrame:
    """iso, feature, value from several sources with -1 for unknown: 'union' takes the largest, 'mean' the mean."""
    known = F.when(F.col("value") >= 0, F.col("value"))
    return sources.groupBy(iso, "feature").agg((F.max(known) if how == "union" else F.avg(known)).alias("value"))


def by_language(df: DataFrame, table: DataFrame, isos: Mapping[str, str], kind: str, lang: str = "L1") -> DataFrame:
    """Rows with their language's distance; null for a language without an iso code or a known component."""
    names = df.sparkSession.createDataFrame(sorted(isos.items()), f"`{lang}` string, iso string")
    return df.join(F.broadcast(names), lang, "left").join(F.broadcast(distance(table, kind)), "iso", "left").drop("iso")
