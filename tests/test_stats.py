"""The distributed exact paths must equal brute force (forced with tiny limits)."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabforge.functions import stats as S
from tabforge.operators.split import split_random, split_stratified


@pytest.fixture
def values(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([rnd.gauss(0, 1), 5.0, 5.0, rnd.random() * 100]) for _ in range(3000)] + [None] * 50
    return vals, spark.createDataFrame([(v,) for v in vals], "x double")


def test_exact_quantiles_refinement_equals_numpy(values):
    vals, df = values
    arr = np.array([v for v in vals if v is not None])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    direct = S.exact_quantiles(df, ["x"], probs)["x"]
    refined = S.exact_quantiles(df, ["x"], probs, direct_limit=100)["x"]
    want = np.percentile(arr, [p * 100 for p in probs])
    assert np.allclose(direct, want, rtol=0, atol=1e-9)
    assert np.allclose(refined, want, rtol=0, atol=1e-9)


def test_quantiles_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert S.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_with_position_distributed_path(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 1000, i) for i in range(1000)], "g int, o int, k int")
    monkeypatch.setattr(S, "DIRECT_RANK_LIMIT", 10)
    got = {r["k"]: r["pos"] for r in S.with_position(df, ["g"], ["o", "k"]).collect()}
    w = Window.partitionBy("g").orderBy("o", "k")
    want = {r["k"]: r["p"] for r in df.select("k", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == want


def test_prefix_sums_distributed_path(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i), i % 5) for i in range(500)], "g int, s double, v int")
    monkeypatch.setattr(S, "DIRECT_RANK_LIMIT", 5)
    got = {(r["g"], r["s"]): r["v_before"] for r in S.with_prefix_sums(df, ["g"], "s", ["v"]).collect()}
    w = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r["g"], r["s"]): r["b"] for r in df.select("g", "s", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("b")).collect()}
    assert got == want


def test_flag_smallest_histogram_equals_window(spark):
    # many rows share hash buckets; forced ties on the exact hash value too
    rows = [(i % 4, (i * 2654435761) % (1 << 32) if i % 50 else 12345, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, h long, k long")
    take = {0: 37, 1: 0, 2: 999, 3: 1000}
    got = {r["k"]: r["selected"] for r in S.flag_smallest(df, "g", "h", "k", list(take.items())).collect()}
    rank = F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))
    want = {r["k"]: r["r"] <= take[r["g"]] for r in df.select("g", "k", rank.alias("r")).collect()}
    assert got == want
    one = {r["k"]: r["selected"] for r in S.flag_smallest(df, None, "h", "k", [(None, 81)]).collect()}
    assert {k for k, v in one.items() if v} == {k for _, _, k in sorted(rows, key=lambda r: r[1:])[:81]}
    with pytest.raises(ValueError):
        S.flag_smallest(df, "g", "h", "k", [(i, 1) for i in range(S.MAX_CLASSES + 1)])


def test_split_plan_moves_no_rows(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id long, y int")
    for flagged in (split_random(df, "id"), split_stratified(df, "id", "y")[0]):
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_quantile_jobs_do_not_grow_with_columns(spark):
    rnd = random.Random(3)
    rows = [tuple(rnd.random() * 10 for _ in range(8)) for _ in range(2000)]
    df = spark.createDataFrame(rows, [f"c{i}" for i in range(8)]).persist()
    df.count()
    jobs = []
    for name, columns, probs in (("few", ["c0"], [0.5]), ("many", df.columns, [0.01, 0.25, 0.5, 0.75, 0.99])):
        spark.sparkContext.setJobGroup(name, name)
        got = S.exact_quantiles(df, columns, probs, direct_limit=50)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        for i, c in enumerate(columns):
            assert np.allclose(got[c], np.percentile([r[i] for r in rows], [100 * p for p in probs]), rtol=0, atol=1e-9)
    assert jobs[1] <= jobs[0] + 3
    df.unpersist()


def test_quantiles_of_one_dominant_value(spark):
    df = spark.createDataFrame([(5.0,)] * 900 + [(float(i),) for i in range(100)], "x double")
    values = [5.0] * 900 + [float(i) for i in range(100)]
    probs = [0.0, 0.004, 0.5, 0.951, 1.0]
    got = S.exact_quantiles(df, ["x"], probs, direct_limit=10)["x"]
    assert np.allclose(got, np.percentile(values, [100 * p for p in probs]), rtol=0, atol=1e-9)
