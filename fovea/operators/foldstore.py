"""Sums of folds kept across runs, found again by tag, columns and content.

What a fold's rows add to a fit depends on these rows alone. So the store keeps each fold's own sums beside a
fingerprint of its rows; a run looks up what it needs by (tag, columns, fold, fingerprint), adds up the folds that
aren't there and publishes them. A changed cell changes the fingerprint of its own fold, a changed list of columns
that of the shape; neither finds what no longer holds. New sums are written aside and appear by a rename, so a run
that dies leaves nothing that another one reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.operators import gram
from fovea.sources.shared import keep, remove

_VERSION = "_version"


def versions(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, _version: a fingerprint of each key's rows, whatever their order."""
    h = F.xxhash64(*columns)
    parts = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(h)), F.sum(h.cast("decimal(38,0)")).cast("string"))
    return rows.groupBy(*keys).agg(parts.alias(_VERSION))


class FoldStore:
    """Keeps fold sums under `root`, a folder that driver and executors share; `tag` names the data and its meaning."""

    def __init__(self, spark: SparkSession, root: str, tag: str):
        self.spark, self.root, self.tag = spark, root, tag

    def _shape(self, keys: Sequence[str], target: str, columns: Sequence[str]) -> str:
        told = json.dumps([self.tag, list(keys), target, list(columns), gram.BLOCK])
        return f"{self.root}/{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def _published(self, shape: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(shape)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(path) if fs.exists(path) else []
        return sorted(str(s.getPath()) for s in found if s.getPath().getName().startswith("sums-"))

    def _publish(self, df: DataFrame, shape: str) -> None:
        name = uuid.uuid4().hex
        aside, to = f"{shape}/_new-{name}", f"{shape}/sums-{name}"
        df.write.parquet(aside)
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = make(aside).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.rename(make(aside), make(to)):
            raise OSError(f"could not publish {to}")

    def sums(self, rows: DataFrame, keys: Sequence[str], target: str, columns: Sequence[str], known: DataFrame | None = None) -> DataFrame:
        """keys, i, j, payload as `gram.sums_by`, from the store where it has them.

        `known`: keys and _version if the caller knows them already (from file names, say): then a run that finds
        everything reads no row at all; else rows are read once for their fingerprints.
        """
        valid = rows.where(F.nanvl(F.col(target).cast("double"), F.lit(None)).isNotNull())
        now = keep((known if known is not None else versions(valid, keys, [target, *columns])).select(*keys, _VERSION))
        shape = self._shape(keys, target, columns)
        paths = self._published(shape)
        held = keep(self.spark.read.parquet(*paths).join(F.broadcast(now), [*keys, _VERSION], "left_semi").dropDuplicates([*keys, "i", "j"])) if paths else None
        missing = now.join(held.select(*keys).distinct(), list(keys), "left_anti") if held is not None else now
        missing = keep(missing)
        if missing.limit(1).count():
            fresh = gram.sums_by(valid.join(missing.select(*keys), list(keys), "left_semi"), keys, target, columns)
            fresh = keep(fresh.join(missing, list(keys)))
            self._publish(fresh, shape)
            held = fresh.unionByName(held) if held is not None else fresh
        return held.drop(_VERSION) if held is not None else gram.sums_by(rows.limit(0), keys, target, columns)

    def prune(self, keys: Sequence[str], target: str, columns: Sequence[str], now: DataFrame) -> None:
        """Leaves what holds `now` (keys, _version) alone."""
        shape = self._shape(keys, target, columns)
        paths = self._published(shape)
        if paths:
            current = keep(self.spark.read.parquet(*paths).join(now, [*keys, _VERSION], "left_semi").dropDuplicates([*keys, "i", "j"]))
            self._publish(current, shape)
            for path in paths:
                remove(self.spark, path)
