import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabforge.plans.config import PreprocessingConfig, TrainingConfig
from tabforge.plans.training_run import run_training


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i in range(240):
        y = 1 if i % 8 == 0 else 0  # imbalanced: 30 positives
        x = (3.0 if y else 0.0) + (i % 7) * 0.1
        rows.append((i, None if i % 11 == 0 else x, "abc"[i % 3], datetime(2024, 1, 1) + timedelta(hours=i),
                     i % 2 == 0, y, x * 2 + 1))
    return spark.createDataFrame(rows, "id long, x double, c string, ts timestamp, flag boolean, y int, target double")


@pytest.mark.parametrize("imbalance", ["none", "class_weight", "smote"])
def test_classification_run(frame, imbalance):
    cfg = TrainingConfig(task_type="classification", target_column="y", excluded_columns=("target",), key_column="id",
                         algorithms=("logistic_regression", "kneighbors"),
                         preprocessing=PreprocessingConfig(imbalance=imbalance, datetime_decompose=True,
                                                           datetime_parts=("hour",)))
    run = run_training(frame, cfg)
    lb = run.leaderboard.collect()
    assert [r["status"] for r in lb] == ["success", "success"]
    assert sum(r["is_best"] for r in lb) == 1 and run.metric_key == "f1"
    if imbalance == "smote":
        counts = {r["label"]: r["count"] for r in run.train_matrix.groupBy("label").count().collect()}
        assert counts[0] == counts[1]


def test_regression_run(frame):
    cfg = TrainingConfig(task_type="regression", target_column="target", excluded_columns=("y",), key_column="id",
                         algorithms=("linear", "ridge", "decision_tree"),
                         preprocessing=PreprocessingConfig(numeric_impute="drop_rows", numeric_scale="robust"))
    run = run_training(frame, cfg, overrides={"decision_tree": {"maxDepth": 4}})
    lb = run.leaderboard.collect()
    assert len(lb) == 3 and lb[0]["rmse"] <= lb[-1]["rmse"] and run.metric_key == "rmse"
    assert run.train_matrix.count() + run.test_matrix.count() == 240 - 22  # rows with missing x dropped


def test_train_save_load_score_without_a_key(spark, frame, tmp_path):
    """The bundle is all that scoring needs; the table has no key column and a row without target."""
    from tabforge.operators.score import predict_batch, warn_unseen_categories
    from tabforge.sources.bundle import load_bundle, load_vocabulary

    table = frame.drop("id", "target").withColumn("many", F.concat(F.lit("v"), F.monotonically_increasing_id().cast("string")))
    table = table.unionByName(table.limit(1).withColumn("y", F.lit(None).cast("int")))
    cfg = TrainingConfig(task_type="classification", target_column="y", algorithms=("kneighbors", "logistic_regression"),
                         preprocessing=PreprocessingConfig(categorical_encoding="frequency"))
    run = run_training(table, cfg)
    assert run.rows_without_target == 1
    assert set(run.plots()) == {"kneighbors", "logistic_regression"}
    assert sum(r["count"] for r in run.plots()["kneighbors"].collect()) == run.test_matrix.count()
    path = run.save(str(tmp_path / "bundle"))
    moved = str(tmp_path / "elsewhere")
    shutil.move(path, moved)
    model, pre, schema, metrics, config, _ = load_bundle(spark, moved)
    assert model.name == run.best().name and config == cfg.preprocessing and "f1" in metrics
    scoring = frame.drop("y").withColumn("many", F.lit("new"))
    out = predict_batch(model, pre, schema, scoring, id_col="id")
    assert out.columns[:2] == ["id", "x"] and out.count() == 240
    assert {r["prediction"] for r in out.collect()} <= {0, 1} and "prob_1" in out.columns
    unseen = warn_unseen_categories(scoring, load_vocabulary(spark, moved, schema), ["c", "many"]).collect()
    assert [(r["column"], r["n_unseen"]) for r in unseen] == [("many", 1)]


def test_smote_on_text_keys(frame):
    cfg = TrainingConfig(task_type="classification", target_column="y", excluded_columns=("target",), key_column="name",
                         algorithms=("logistic_regression",), preprocessing=PreprocessingConfig(imbalance="smote"))
    run = run_training(frame.withColumn("name", F.concat(F.lit("row "), F.col("id").cast("string"))).drop("id"), cfg)
    counts = {r["label"]: r["count"] for r in run.train_matrix.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
