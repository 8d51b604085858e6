"""Column ranges from Parquet footers, against the data."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fovea import sources


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    root = tmp_path_factory.mktemp("wide") / "t"
    root.mkdir()
    rng = np.random.default_rng(1)
    n = 40
    for part in range(2):
        some = [None if k % 3 else float(k) for k in range(n)]
        columns = {
            "whole": pa.array(np.arange(n) + part * 100), "zero": pa.array(np.zeros(n)), "gone": pa.array([None] * n, pa.float64()), "gaps": pa.array(some),
            "nan": pa.array([math.nan if k % 2 else float(k) for k in range(n)]), "only_nan": pa.array([math.nan] * n), "real": pa.array(rng.normal(size=n).astype(np.float32)),
            "text": pa.array(["x"] * n), "flag": pa.array([part == 0] * n), "zero_and_gaps": pa.array([None if k % 2 else 0.0 for k in range(n)]),
            "no_stats": pa.array(np.arange(n) * 1.5),
        }
        pq.write_table(pa.table(columns), root / f"p{part}.parquet", row_group_size=15, write_statistics=[c for c in columns if c != "no_stats"])
    return str(root)


def plain(path):
    out = {}
    table = pq.read_table(path)
    for c in table.column_names:
        if c == "text":
            continue
        values = [float(v) for v in table[c].to_pylist() if v is not None and not (isinstance(v, float) and math.isnan(v))]
        out[c] = (min(values, default=None), max(values, default=None))
    return out


def test_ranges_equal_the_data(spark, path):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {r["column"]: r for r in sources.column_ranges(spark, path).collect()}
    want = plain(path)
    assert got.keys() == want.keys()
    for c, (low, high) in want.items():
        assert (got[c]["low"], got[c]["high"]) == (low, high), c
    assert got["whole"]["filled"] == 80 and got["gone"]["filled"] == 0 and got["gaps"]["filled"] == 28
    assert set(sources.live_columns(spark, path)) == {"whole", "gaps", "nan", "real", "flag", "no_stats"}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert [r["column"] for r in sources.column_ranges(spark, path, ["real", "zero"]).collect()] == ["real", "zero"]


def test_footers_answer_without_data_pages(spark, path):
    with sources._settings(spark, sources._FOOTERS):
        plan = spark.read.parquet(path).selectExpr("min(whole)", "max(whole)", "count(gaps)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(whole), MAX(whole), COUNT(gaps)]" in plan
