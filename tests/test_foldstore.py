"""Fold sums found again by content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import foldstore, gram


@pytest.fixture
def counted(monkeypatch):
    """Rows that were added up, call by call."""
    seen, real = [], gram.sums_by
    monkeypatch.setattr(gram, "sums_by", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    return seen


def table(spark, changed=None):
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, *map(float, rng.normal(size=3))) for i in range(40)]
    if changed is not None:
        rows[changed] = (*rows[changed][:2], 9.0, *rows[changed][3:])
    return spark.createDataFrame(rows, "who long, fold int, y double, a double, b double").repartition(3)


def predict(df, columns, store=None):
    out = gram.predicted(df, df, "who", "y", columns, (), ["fold"], (0.1, 10.0), sums=store.sums if store else None)
    return {r["who"]: r["pred"] for r in out.collect()}


def test_only_changed_folds_are_added_up(spark, tmp_path, counted):
    store = foldstore.FoldStore(spark, str(tmp_path), "t1")
    first = predict(table(spark), ["a", "b"], store)
    assert counted == [40]
    assert predict(table(spark), ["a", "b"], store) == first and counted == [40]
    moved = predict(table(spark, changed=6), ["a", "b"], store)
    assert counted == [40, 10]  # the fold of row 6
    plain = predict(table(spark, changed=6), ["a", "b"])
    assert moved == pytest.approx(plain) and moved != first
    del counted[:]
    assert predict(table(spark), ["a", "b"], store) == pytest.approx(first) and counted == []
    predict(table(spark), ["a"], store)
    predict(table(spark), ["a", "b"], foldstore.FoldStore(spark, str(tmp_path), "t2"))
    assert counted == [40, 40]


def test_known_versions_read_no_row(spark, tmp_path, counted):
    store = foldstore.FoldStore(spark, str(tmp_path), "t")
    df = table(spark)
    known = foldstore.versions(df, ["fold"], ["y", "a"])
    store.sums(df, ["fold"], "y", ["a"], known).collect()
    stopped = df.withColumn("y", F.raise_error(F.lit("read")).cast("double"))
    assert store.sums(stopped, ["fold"], "y", ["a"], spark.createDataFrame(known.collect(), known.schema)).count() == 8
    assert counted == [40]


def test_what_was_not_published_is_not_read(spark, tmp_path, counted, monkeypatch):
    store = foldstore.FoldStore(spark, str(tmp_path), "t")

    def dies(self, df, shape):
        df.write.parquet(f"{shape}/_new-half")
        raise InterruptedError

    with monkeypatch.context() as m, pytest.raises(InterruptedError):
        m.setattr(foldstore.FoldStore, "_publish", dies)
        store.sums(table(spark), ["fold"], "y", ["a"])
    store.sums(table(spark), ["fold"], "y", ["a"]).collect()
    store.sums(table(spark, changed=1), ["fold"], "y", ["b"]).collect()
    assert counted == [40, 40, 40]
    now = foldstore.versions(table(spark), ["fold"], ["y", "a"])
    store.sums(table(spark, changed=1), ["fold"], "y", ["a"]).collect()
    store.prune(["fold"], "y", ["a"], now)
    store.sums(table(spark), ["fold"], "y", ["a"]).collect()
    store.sums(table(spark, changed=1), ["fold"], "y", ["a"]).collect()
    assert counted == [40, 40, 40, 10, 10]


def test_empty_tables(spark, tmp_path):
    store = foldstore.FoldStore(spark, str(tmp_path), "t")
    assert store.sums(table(spark).limit(0), ["fold"], "y", ["a"]).count() == 0
