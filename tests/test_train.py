import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabforge.operators import train as TR
from tabforge.operators.score import score_models
from tabforge.plans.config import TrainingConfig


@pytest.fixture
def cls_data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((i, Vectors.dense([rng.normal(2 * y, 0.5), rng.normal(-y, 0.5)]), y))
    return spark.createDataFrame(rows, ["id", "features", "label"])


SMALL = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "extra_trees": {"numTrees": 5, "maxDepth": 4},
         "gradient_boosting": {"maxIter": 5}, "hist_gradient_boosting": {"maxIter": 5}, "decision_tree": {"maxDepth": 4}}


def test_train_all_and_score(cls_data):
    train = cls_data.where(F.col("id") % 5 != 0)
    test = cls_data.where(F.col("id") % 5 == 0)
    specs = TR.get_specs("classification")
    trained = TR.train_all(specs, train, "classification", id_col="id", overrides=SMALL)
    assert [t.name for t in trained] == [s.name for s in specs]
    assert all(t.is_success for t in trained), [t.error for t in trained]
    scores = score_models(trained, test, "classification", id_col="id")
    acc = {r["algo"]: r["value"] for r in scores.where("metric = 'accuracy'").collect()}
    assert min(acc.values()) > 0.8
    for t in trained:
        labels = {r["prediction"] for r in t.predict(test, "id").collect()}
        assert labels <= {0, 1}


def test_failure_is_isolated(cls_data):
    bad = TR.AlgoSpec("broken", "classification", "f1", lambda c, o: (_ for _ in ()).throw(RuntimeError("boom")))
    good = TR.get_specs("classification", ["logistic_regression"])
    out = TR.train_all([bad] + good, cls_data, "classification", id_col="id")
    assert out[0].status == "failed" and "boom" in out[0].error and out[1].is_success


def test_logistic_matches_penalised_optimum(cls_data):
    m = TR.train_all(TR.get_specs("classification", ["logistic_regression"]), cls_data, "classification",
                     id_col="id")[0].model
    rows = cls_data.collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(X @ w + b)))
    # gradient of 0.5·|w|² + C·Σ logloss with C = 1 vanishes at the optimum
    grad_w = w + X.T @ (p - y)
    assert np.abs(grad_w).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_unknown_algorithm():
    with pytest.raises(KeyError):
        TR.get_specs("classification", ["svm"])
    with pytest.raises(ValueError):
        TrainingConfig(task_type="regression", target_column="y", preprocessing=__import__(
            "tabforge.plans.config", fromlist=["PreprocessingConfig"]).PreprocessingConfig(imbalance="smote"))
    with pytest.raises(ValueError):
        TrainingConfig(task_type="classification", target_column="y", algorithms=())
