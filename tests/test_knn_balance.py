import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import balance as B
from tabforge.operators import knn as K
from tabforge.operators.knn import knn, knn_classify


def _points(n, d, seed, clustered):
    rnd = random.Random(seed)
    centers = [[rnd.uniform(-10, 10) for _ in range(d)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centers[i % 5] if clustered else [0.0] * d
        out.append([round(x + rnd.gauss(0, 1), 1) for x in c])  # rounding creates exact ties
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_knn_is_exact(spark, clustered):
    pts = _points(400, 6, 3, clustered)
    tr = spark.createDataFrame([(i, p) for i, p in enumerate(pts[:300])], "id long, vec array<double>")
    qu = spark.createDataFrame([(1000 + i, p) for i, p in enumerate(pts[300:])], "id long, vec array<double>")
    got = {}
    for r in knn(qu, tr, 5, id_col="id", vec_col="vec", max_pivots=16).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["t_id"]))
    T = np.array(pts[:300])
    for qi, q in enumerate(pts[300:]):
        d = np.sqrt(((T - np.array(q)) ** 2).sum(axis=1))
        order = sorted(range(300), key=lambda j: (d[j], j))[:5]
        assert [t for _, t in sorted(got[1000 + qi])] == order


def test_knn_exclude_self_and_vote(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "a"), (3, [5.0], "b"), (4, [5.1], "b"), (5, [0.2], "b")],
                               "id long, vec array<double>, label string")
    nn = knn(df, df, 2, id_col="id", vec_col="vec", exclude_self=True)
    assert nn.where(F.col("q_id") == F.col("t_id")).count() == 0
    pred = {r["q_id"]: r["prediction"] for r in knn_classify(nn, df.select(F.col("id").alias("t_id"), "label")).collect()}
    assert pred[3] == "b" and pred[1] == "a"


def test_smote_balances_classes(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)], 0) for i in range(200)]
    rows += [(1000 + i, [rnd.gauss(3, 1) for _ in range(3)], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    res = B.smote_resample(df, id_col="id", label_col="label", vec_col="vec", k=5)
    counts = {r["label"]: r["count"] for r in res.groupBy("label").count().collect()}
    assert counts == {0: 200, 1: 200}
    assert res.select("id").distinct().count() == 400
    syn = B.smote(df, id_col="id", label_col="label", vec_col="vec", k=5)
    assert all(0.0 <= r["u"] < 1.0 for r in syn.collect())


def test_smote_guards(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(8)], "id long, vec array<double>, label int")
    df = df.union(spark.createDataFrame([(100, [1.0], 0)], "id long, vec array<double>, label int"))
    with pytest.raises(ValueError):
        B.smote(df, id_col="id", label_col="label", vec_col="vec", k=5)
    with pytest.raises(ValueError):
        B.smote(df, id_col="id", label_col="label", vec_col="vec", task_type="regression")


def test_equal_vectors_keep_the_smallest_ids(spark):
    rows = spark.range(0, 9000, 1, 3).selectExpr("id", "array(cast(id % 3 as double)) as vec")
    kept = K._packed(rows.selectExpr("id", "vec", "0 as grp"), 4, 1).selectExpr("octet_length(x) / 8 as x", "size(ids) as n").collect()
    assert all((r["x"], r["n"]) == (3, 12) for r in kept)
    got = knn(rows.where("id < 30"), rows, 4, exclude_self=True, id_col="id", vec_col="vec").collect()
    for q in range(30):
        near = [r["t_id"] for r in sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])]
        assert near == [i for i in range(q % 3, 18, 3) if i != q][:4]


def test_far_offsets_ids_of_text_and_missing_components(spark):
    rng = np.random.default_rng(5)
    x = 1e9 + np.round(rng.normal(size=(700, 2)), 2)
    x[3, 1] = np.nan
    rows = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(x.tolist())], "id string, vec array<double>")
    got = {}
    for r in knn(rows.limit(40), rows, 3, id_col="id", vec_col="vec").collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["t_id"]))
    for q, near in got.items():
        d = np.sqrt(((x - x[int(q[1:])]) ** 2).sum(axis=1))
        order = sorted(range(700), key=lambda j: (np.isnan(d[j]), d[j] if d[j] == d[j] else 0, j))[:3]
        assert [t for _, t in sorted(near)] == [f"k{j:03}" for j in order]
    assert len(got) == 40
    with pytest.raises(Exception, match="different lengths"):
        knn(spark.createDataFrame([(1, [0.0])], "id long, vec array<double>"), rows, 3, id_col="id", vec_col="vec").collect()
