"""Every registered query against DuckDB on the same tables."""

import inspect
import math

import duckdb
import pytest

import __spark_entry__ as entry
from fovea import catalog
from fovea.operators import debias, models, stats
from fovea.plans import roles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return float(v) if hasattr(v, "as_tuple") else v


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_realigned_words_hold_every_participant(spark, sf):
    words = roles.words(spark, sf).select("participant_id", "paragraph", "word", "ptb_pos").collect()
    gone = {}
    for r in words:
        if r["ptb_pos"] == "R":
            gone.setdefault((r["participant_id"], r["paragraph"]), set()).add(r["word"])
    want = []
    for p, q, word, _ in words:
        dropped = gone.get((p, q), set())
        if word not in dropped:
            want.append((p, q, word - sum(g < word for g in dropped)))
    got = [tuple(r) for r in catalog.queries()["realigned_words"](spark, sf).select("participant_id", "paragraph", "word").collect()]
    assert sorted(got) == sorted(want) and any(p % 10 for p, _, _ in got)


@pytest.mark.parametrize(
    "name,module,function,want",
    [
        ("bootstrap_by_region", stats, "bootstrap", {"draws": 100_000}),
        ("bootstrap_pair_by_region", stats, "bootstrap_difference", {"draws": 100_000}),
        ("debias_gain", debias, "delta_r_bootstrap", {"draws": 10_000}),
        ("forest_predictions", models, "tree_model", {"trees": 200}),
        ("first_component", stats, "first_component", {"rounds": 500, "tolerance": 1e-9}),
    ],
)
def test_registered_queries_run_the_references_numbers(spark, sf, monkeypatch, name, module, function, want):
    real, seen = getattr(module, function), {}

    def spy(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(module, function, spy)
    with pytest.raises(InterruptedError):
        catalog.queries()[name](spark, sf)
    assert {k: seen[k] for k in want} == want


def test_feature_cover_joins_the_line_items_once(spark, sf):
    plan = catalog.queries()["feature_cover"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_feature_cover_counts_readers_of_every_nation(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, "NATION_1", 0), (1, "NATION_2", 0), (2, "nation", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(k, "c", k % 3, 1.0, "g") for k in range(6)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("orders", [(k, k) for k in range(6)], "o_orderkey bigint, o_custkey bigint")
    # feature 1 all have, feature 2 all but a reader of the last nation, feature 3 only readers of the second
    parts = [(k, 1) for k in range(6)] + [(k, 2) for k in range(5)] + [(k, 3) for k in (1, 4)]
    put("lineitem", [(k, part, 10.0 * part + k) for k, part in parts], "l_orderkey bigint, l_partkey bigint, l_quantity double")
    got = {r["feature"]: (r["n"], r["everybody"]) for r in catalog.queries()["feature_cover"](spark, str(tmp_path)).collect()}
    assert got == {1: (6, True), 2: (5, False), 3: (2, False)}


def test_direction_scores_join_statistics_of_known_size(spark, sf):
    plan = catalog.queries()["direction_cosine"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and "Join" in plan
