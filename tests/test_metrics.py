import itertools

import pytest
from pyspark.sql import functions as F

from tabforge.operators import metrics as M


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 0)], "y int, p int")
    cm = {(r["true_label"], r["pred_label"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cm == {("0", "0"): 2, ("0", "1"): 0, ("1", "0"): 1, ("1", "1"): 1}
    assert M.confusion_matrix(df, "y", "p", labels=["a", "b", "c"]).count() == 9


def test_labels_sort_as_text(spark):
    df = spark.createDataFrame([(10, 2), (2, 10)], "y int, p int")
    rows = M.confusion_matrix(df, "y", "p").orderBy("row_idx").collect()
    assert rows[0]["true_label"] == "10"


def test_f1_and_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    assert M.accuracy(df, "y", "p") == 0.6
    assert abs(M.f1_binary(df, "y", "p", 1) - 2 * 2 / (2 * 2 + 1 + 1)) < 1e-12
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert M.f1_binary(none, "y", "p", 1) == 0.0


def test_auc_matches_pairwise(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.7), (0, 0.7), (0, 0.1)]
    df = spark.createDataFrame(data, "y int, s double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(M.roc_auc_binary(df, "y", "s", 1) - want) < 1e-12


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics_df(df, "y", "p").first()
    assert abs(r["mae"] - 0.5) < 1e-12 and abs(r["r2"] - (1 - 1.25 / 2.0)) < 1e-12
    const = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics_df(const, "y", "p").first()["r2"] == 1.0


def _scores(spark, rows):
    return spark.createDataFrame(rows, "algo string, order int, status string, metric string, value double")


def test_select_best(spark):
    s = _scores(spark, [("a", 0, "success", "f1", 0.70), ("b", 1, "success", "f1", 0.85), ("c", 2, "success", "f1", 0.80),
                        ("d", 3, "failed", None, None), ("e", 4, "success", "accuracy", 0.99)])
    assert M.select_best(s, "f1").first()["algo"] == "b"
    r = _scores(spark, [("a", 0, "success", "rmse", 1.2), ("b", 1, "success", "rmse", 0.8), ("c", 2, "success", "rmse", 2.0)])
    assert M.select_best(r, "rmse").first()["algo"] == "b"
    assert M.select_best(r, "f1").count() == 0
    with pytest.raises(ValueError):
        M.select_best(r, "nope")
    tie = _scores(spark, [("x", 0, "success", "f1", 0.5), ("y", 1, "success", "f1", 0.5)])
    assert M.select_best(tie, "f1").first()["algo"] == "x"


def test_scatter_sample(spark):
    df = spark.createDataFrame([(i, float(i), float(i) + 1) for i in range(4500)], "k int, y double, p double")
    out = M.scatter_sample(df, "y", "p", ["k"], max_points=2000)
    assert out.count() == 2000 and out.agg({"pos": "max"}).first()[0] == 3998


def test_auc_undefined_without_both_classes(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, s double")
    assert M.roc_auc_binary(df, "y", "s", 1) is None


def test_confusion_matrix_of_many_labels_lists_the_pairs_that_occur(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_DENSE_LABELS", 50)
    df = spark.range(3000).select((F.col("id") % 300).alias("y"), (F.col("id") % 100).alias("p"))
    got = M.confusion_matrix(df, "y", "p").collect()
    names = sorted(str(i) for i in range(300))
    assert {(r["true_label"], r["pred_label"]): r["count"] for r in got} == {(str(i), str(i % 100)): 10 for i in range(300)}
    assert all(names[r["row_idx"]] == r["true_label"] and names[r["col_idx"]] == r["pred_label"] for r in got)


def test_confusion_matrix_with_missing_labels_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("b", "b")], "y string, p string")
    got = {(r["true_label"], r["pred_label"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 1}
    assert M.confusion_matrix(df.limit(0), "y", "p").collect() == []
