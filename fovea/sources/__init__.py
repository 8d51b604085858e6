"""Reading and writing tables and result trees."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one of the schema where nothing has been written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def reports(spark: SparkSession, paths: Sequence[str], schema: StructType, encoding: str = "UTF-8", names: Mapping[str, str] | None = None) -> DataFrame:
    """Delimited reports with a header and a given schema, never an inferred one; renamed, with their file's name."""
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(list(paths))
    return df.withColumnsRenamed(dict(names or {})).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def waves(*frames: DataFrame) -> DataFrame:
    """All rows of all waves; a column that a wave lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_by(df: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    """Parquet with one folder for each key value, one shuffle to gather them and no tiny files."""
    (df.repartition(*keys) if keys else df).write.mode(mode).partitionBy(*keys).parquet(path)


def missing_items(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of items that haven't been written yet."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, scope: Mapping[str, Sequence] | None = None) -> DataFrame:
    """New rows, and the old ones that this run didn't cover. Covered: every filter of the scope holds; no scope: all."""
    if not scope:
        return new
    covered = F.lit(True)
    for column, values in scope.items():
        covered = covered & F.coalesce(F.col(column).isin(*values), F.lit(False))
    return old.where(~covered).unionByName(new, allowMissingColumns=True)


def upsert_on_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(df: DataFrame) -> str:
    """Of a table's rows, whatever their order, and of its column names."""
    columns = sorted(df.columns)
    rows = df.select(F.xxhash64(*columns).alias("h"))
    n, mixed, total = rows.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{'-'.join(columns)}:{n}:{mixed}:{total}"


def path_parts(path: str, names: Sequence[str]) -> dict[str, F.Column]:
    """The last folders of a result path as columns, first to last."""
    parts = F.split(path, "/")
    return {name: F.try_element_at(parts, F.lit(k - len(names) - 1)) for k, name in enumerate(names)}


def version_and_inner(version: str) -> dict[str, F.Column]:
    """A version path without its last segment inner_<scheme>, and the scheme."""
    scheme = F.regexp_extract(version, r"(?:^|/)inner_([^/]+)$", 1)
    return {"version": F.regexp_replace(version, r"(?:^|/)inner_[^/]+$", ""), "inner": F.nullif(scheme, F.lit(""))}


def stem_and_variant(name: str) -> dict[str, F.Column]:
    """A file name 'SET_variant.csv' split at its first lower-case suffix; without one the variant is 'raw'."""
    stem = F.regexp_extract(name, r"^([A-Z0-9_]+?)(?:_([a-z].*?))?(?:\.\w+)?$", 1)
    variant = F.regexp_extract(name, r"^([A-Z0-9_]+?)(?:_([a-z].*?))?(?:\.\w+)?$", 2)
    return {"feature_set": stem, "variant": F.coalesce(F.nullif(variant, F.lit("")), F.lit("raw"))}


def aligned_union(a: DataFrame, b: DataFrame, tag: str, names: tuple[str, str], fill: float = 0.0) -> DataFrame:
    """Two cohorts' wide features over the sorted union of their columns, a cohort's missing ones filled."""
    columns = sorted(set(a.columns) | set(b.columns))

    def side(df: DataFrame, name: str) -> DataFrame:
        kinds = dict(a.dtypes) | dict(b.dtypes)
        return df.select(*[F.col(c) if c in df.columns else F.lit(fill).cast(kinds[c]).alias(c) for c in columns], F.lit(name).alias(tag))

    return side(a, names[0]).unionByName(side(b, names[1]))


_FOOTERS = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def column_ranges(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """column, low, high (doubles), filled (values that are there) of a Parquet table's numeric columns, from the files' footers.

    Spark answers minima, maxima and counts from the statistics of row groups, in tasks, without reading data pages.
    Files may lack them, as for columns that hold a NaN: such columns are found by halving the list and read
    themselves; NaN then is no value. The driver gets a line a column.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    rows: list[tuple] = []

    def asked(df: DataFrame, names: Sequence[str], clean: bool) -> list[tuple]:
        value = lambda c: F.nanvl(F.col(c), F.lit(None)) if clean and kinds[c] in ("float", "double") else F.col(c)
        one = df.agg(*[f(value(c)).alias(f"{i}_{j}") for i, c in enumerate(names) for j, f in enumerate((F.min, F.max, F.count))]).first()
        number = lambda v: None if v is None else float(v)
        return [(c, number(one[3 * i]), number(one[3 * i + 1]), one[3 * i + 2]) for i, c in enumerate(names)]

    def from_footers(names: Sequence[str]) -> list[str]:
        """Adds the columns whose statistics are complete; the others."""
        try:
            rows.extend(asked(table, names, False))
            return []
        except Exception as missing:  # the reader stops where a row group lacks statistics
            if "spark.sql.parquet.aggregatePushdown" not in str(missing):
                raise
            half = len(names) // 2
            return list(names) if not half else from_footers(names[:half]) + from_footers(names[half:])

    with _settings(spark, _FOOTERS):
        table = spark.read.parquet(path)
        kinds = dict(table.dtypes)
        wanted = [c for c in (columns or table.columns) if kinds[c] in numeric]
        left = from_footers(wanted) if wanted else []
    if left:
        rows.extend(asked(spark.read.parquet(path), left, True))
    order = {c: i for i, c in enumerate(wanted)}
    return spark.createDataFrame(sorted(rows, key=lambda r: order[r[0]]), "column string, low double, high double, filled long")


def live_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> list[str]:
    """The numeric columns with any value but 0 and NaN, by `column_ranges`."""
    return [r["column"] for r in column_ranges(spark, path, columns).collect() if r["filled"] and r["low"] is not None and (r["low"] != 0 or r["high"] != 0)]


def live_features(long: DataFrame, corpus: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """corpus, features: how many of a long table have any non-zero value. For wide Parquet: `live_columns`."""
    return long.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(corpus).agg(F.countDistinct(feature).alias("features"))


def item_scores(spark: SparkSession, root: str, schema: StructType, value: str = "score", **cell: str) -> DataFrame:
    """Stored scores by item of one result cell (dataset, preview, pool, level, ...): folders that don't match aren't read.

    An absent tree gives no rows; rows without a score are left out.
    """
    rows = optional(spark, root, schema)
    for column, wanted in cell.items():
        rows = rows.where(F.col(column) == wanted)
    return rows.where(F.col(value).isNotNull())


def original_scores(rows: DataFrame, who: str, value: str) -> DataFrame:
    """who, original: the mean stored score or prediction of each participant."""
    return rows.groupBy(who).agg(F.avg(value).alias("original"))
