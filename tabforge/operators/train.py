"""Algorithm registry and training loop: linear models of ``pyspark.ml``, own trees and boosting, kNN.

Every spec builds a distributed estimator from the training statistics it needs
(row count, label spread); trees of any depth are :mod:`tabforge.operators.trees`,
boosting is :mod:`tabforge.operators.boosting`. One failure becomes a ``failed`` model and never
stops the others. The feature matrix is assembled and cached once; each spec is
its own set of Spark jobs, and a few specs run at a time.

What a fit costs may be bounded with ``max_fit_rows``: the labelled rows with the
smallest key hashes. It is off unless asked for, and nothing else depends on the
number of rows.

Regularisation is mapped so results equal the reference's objective:
logistic ``regParam = 1/(C·n)``; ridge ``regParam = α·σ_y/n``; lasso
``regParam = α, elasticNetParam = 1``; elastic net ``reg = α·l1 + α(1−l1)·σ_y``,
``elasticNetParam = α·l1/reg`` (all with ``standardization=False``; σ_y is
the population standard deviation of the label).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import DEFAULT_SEED, hash32
from tabforge.functions.stats import flag_smallest
from tabforge.operators.boosting import BoostEstimator, BoostParams
from tabforge.operators.knn import knn, knn_classify, knn_regress
from tabforge.operators.split import class_counts
from tabforge.operators.trees import ForestEstimator, ForestParams, TreeModel


@dataclass(frozen=True)
class AlgoSpec:
    name: str
    task: str
    default_metric: str
    build: Callable[[dict[str, Any], dict[str, Any]], Any]
    supports_weight: bool = False
    defaults: dict[str, Any] = field(default_factory=dict)


def _p(params: dict, overrides: dict, **defaults) -> dict:
    out = dict(defaults)
    out.update({k: v for k, v in overrides.items() if k in defaults})
    return out


def _logistic(ctx, ov):
    p = _p({}, ov, maxIter=1000, C=1.0)
    return LogisticRegression(maxIter=p["maxIter"], regParam=1.0 / (p["C"] * ctx["n"]), elasticNetParam=0.0,
                              standardization=False, tol=1e-6)


def _forest(trees: int, **kw):
    """Trees are grown to the end unless ``maxDepth`` is given."""
    def build(ctx, ov):
        p = _p({}, ov, numTrees=trees, maxDepth=None, bootstrap=kw.get("bootstrap", False))
        params = ForestParams(trees=p["numTrees"], max_depth=p["maxDepth"], bootstrap=p["bootstrap"], seed=DEFAULT_SEED,
                              tries=kw.get("tries", "all") if "n_classes" in ctx else "all",
                              random_cuts=kw.get("random_cuts", False))
        return ForestEstimator(params, ctx.get("n_classes", 0))
    return build


def _boosting(rounds: int, *, hist: bool):
    def build(ctx, ov):
        p = _p({}, ov, maxIter=rounds, stepSize=0.1, maxDepth=None if hist else 3, maxLeaves=31 if hist else None)
        if ctx.get("n_classes", 2) < 2:
            raise ValueError("boosting needs two classes at least")
        return BoostEstimator(BoostParams(
            ctx.get("n_classes", 0), p["maxIter"], rate=p["stepSize"], max_depth=p["maxDepth"], max_leaves=p["maxLeaves"],
            min_rows=20 if hist else 1, newton=hist, patience=10 if hist and ctx.get("early_stopping") else None))
    return build


def _linear(ctx, ov):
    return LinearRegression(solver="normal", standardization=False, regParam=0.0)


def _ridge(ctx, ov):
    a = ov.get("alpha", 1.0)
    return LinearRegression(solver="normal", standardization=False, regParam=a * ctx["sd_y"] / ctx["n"],
                            elasticNetParam=0.0)


def _lasso(ctx, ov):
    a = ov.get("alpha", 1.0)
    return LinearRegression(standardization=False, regParam=a, elasticNetParam=1.0, maxIter=ov.get("maxIter", 1000),
                            tol=1e-10)


def _elastic(ctx, ov):
    a, l1 = ov.get("alpha", 0.5), ov.get("l1_ratio", 0.5)
    reg = a * l1 + a * (1 - l1) * ctx["sd_y"]
    return LinearRegression(standardization=False, regParam=reg, elasticNetParam=(a * l1 / reg) if reg else 0.0,
                            maxIter=ov.get("maxIter", 5000), tol=1e-10)


KNN = "kneighbors"

# The reference's registry order and default metrics.
CLASSIFICATION_SPECS = [
    AlgoSpec("logistic_regression", "classification", "f1", _logistic, True),
    AlgoSpec("decision_tree", "classification", "f1", _forest(1), True),
    AlgoSpec("random_forest", "classification", "f1", _forest(200, tries="sqrt", bootstrap=True), True),
    AlgoSpec("hist_gradient_boosting", "classification", "f1", _boosting(300, hist=True), True),
    AlgoSpec("extra_trees", "classification", "f1", _forest(300, tries="sqrt", random_cuts=True), True),
    AlgoSpec("gradient_boosting", "classification", "f1", _boosting(200, hist=False), False),
    AlgoSpec(KNN, "classification", "f1", lambda c, o: KNN, False),
]
REGRESSION_SPECS = [
    AlgoSpec("linear", "regression", "rmse", _linear),
    AlgoSpec("ridge", "regression", "rmse", _ridge),
    AlgoSpec("lasso", "regression", "rmse", _lasso),
    AlgoSpec("random_forest", "regression", "rmse", _forest(200, bootstrap=True)),
    AlgoSpec("hist_gradient_boosting", "regression", "rmse", _boosting(300, hist=True)),
    AlgoSpec("extra_trees", "regression", "rmse", _forest(300, random_cuts=True)),
    AlgoSpec("gradient_boosting", "regression", "rmse", _boosting(200, hist=False)),
    AlgoSpec(KNN, "regression", "rmse", lambda c, o: KNN),
    AlgoSpec("elastic_net", "regression", "rmse", _elastic),
    AlgoSpec("decision_tree", "regression", "rmse", _forest(1)),
]


def get_specs(task: str, names: Sequence[str] | None = None) -> list[AlgoSpec]:
    specs = CLASSIFICATION_SPECS if task == "classification" else REGRESSION_SPECS if task == "regression" else None
    if specs is None:
        raise ValueError(f"unknown task_type: {task}")
    if names is None:
        return list(specs)
    known = {s.name for s in specs}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise KeyError(f"unknown algorithms for {task}: {unknown}")
    return [s for s in specs if s.name in set(names)]


def default_metric(task: str, names: Sequence[str] | None = None) -> str:
    return get_specs(task, names)[0].default_metric


# --------------------------------------------------------------------- matrix


def assemble(df: DataFrame, feature_cols: Sequence[str], out: str = "features") -> DataFrame:
    """Named double columns → one vector column (missing stays NaN)."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="keep").transform(df)


def class_index(labels: Sequence) -> dict:
    """Sorted class list (numbers numerically, text lexicographically)."""
    return {v: i for i, v in enumerate(sorted(labels))}


@dataclass
class TrainedModel:
    name: str
    task: str
    status: str
    train_time_ms: int
    model: Any = None
    error: str | None = None
    classes: list | None = None
    knn_train: DataFrame | None = None
    k: int = 5

    @property
    def is_success(self) -> bool:
        return self.status == "success"

    def predict(self, df: DataFrame, id_col: str, features_col: str = "features", keep: Sequence[str] = ()) -> DataFrame:
        """(id, kept columns, prediction[, probability array in class order]).

        One narrow pass; only a nearest-neighbour model joins, on the id.
        """
        if self.model == KNN:
            out = self._neighbours(df, id_col, features_col)
            if keep:
                out = df.select(id_col, *keep).join(out, id_col)
        else:
            out = self.model.transform(df.select(id_col, *keep, features_col))
            if self.task == "classification" and "probability" in out.columns and not isinstance(self.model, TreeModel):
                out = out.withColumn("probability", vector_to_array("probability"))
        if self.task == "classification":
            back = F.create_map(*[x for i, v in enumerate(self.classes) for x in (F.lit(float(i)), F.lit(v))])
            out = out.withColumn("prediction", back[F.col("prediction")])
        scores = ["probability"] if "probability" in out.columns else []
        return out.select(id_col, *keep, "prediction", *scores)

    def _neighbours(self, df: DataFrame, id_col: str, features_col: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), vector_to_array(F.col(features_col)).alias("vec"))
        near = knn(rows, self.knn_train.select("id", "vec"), self.k, id_col="id", vec_col="vec")
        labels = self.knn_train.select(F.col("id").alias("t_id"), "label")
        if self.task == "regression":
            return knn_regress(near, labels, "label").select(F.col("q_id").alias(id_col), "prediction")
        share = [F.coalesce(F.col("probs")[str(float(i))], F.lit(0.0)) for i in range(len(self.classes))]
        return knn_classify(near, labels, "label").select(
            F.col("q_id").alias(id_col), F.col("prediction").cast("double").alias("prediction"), F.array(*share).alias("probability"))


def _label_stats(train: DataFrame, task: str) -> dict[str, Any]:
    if task == "classification":
        counts = class_counts(train, "label")  # refuses a label with too many values
        return {"n": sum(n for _, n in counts), "classes": [c for c, _ in counts], "n_classes": len(counts)}
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    return {"n": r["n"], "sd_y": r["sd"] or 0.0}


def _fit(spec: AlgoSpec, data: DataFrame, ctx: dict[str, Any], *, id_col: str, override: dict, weight_col: str | None,
         k_neighbors: int) -> TrainedModel:
    """Fit one spec; an error becomes a failed model."""
    start = time.perf_counter()
    out = TrainedModel(spec.name, spec.task, "success", 0, classes=ctx.get("classes"))
    try:
        est = spec.build(ctx, override)
        if est == KNN:
            out.model, out.k = KNN, k_neighbors
            out.knn_train = data.select(F.col(id_col).alias("id"), vector_to_array("features").alias("vec"),
                                        F.col("_label").alias("label"))
        elif hasattr(est, "fit_rows"):
            out.model = est.fit_rows(data, key=id_col, label="_label", weight=weight_col if spec.supports_weight else None,
                                     **({"valid": "_valid"} if ctx.get("early_stopping") else {}))
        else:
            est = est.setFeaturesCol("features").setLabelCol("_label")
            if weight_col and spec.supports_weight and hasattr(est, "setWeightCol"):
                est = est.setWeightCol(weight_col)
            out.model = est.fit(data)
    except Exception as e:  # noqa: BLE001 — one failing algorithm must not stop the others
        out.status, out.error = "failed", str(e)
    out.train_time_ms = int((time.perf_counter() - start) * 1000)
    return out


def bounded_rows(train: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest key hashes: a filter by the boundary, rows stay in their partitions."""
    hashed = train.withColumn("_hash", hash32(F.col(id_col), "fit"))
    return flag_smallest(hashed, None, "_hash", id_col, [(None, rows)], "_fitted").where("_fitted").drop("_hash", "_fitted")


def train_all(specs: Sequence[AlgoSpec], train: DataFrame, task: str, *, id_col: str, overrides: dict | None = None,
              weight_col: str | None = None, k_neighbors: int = 5, early_stopping: bool = False,
              max_fit_rows: int | None = None, at_once: int = 4) -> list[TrainedModel]:
    """Fit every spec on ``train`` (id, features vector, label[, weight]); failures isolated.

    ``early_stopping`` holds a tenth of the rows (by key hash) out of histogram
    boosting and stops it when they no longer gain. ``max_fit_rows`` fits on at most
    that many rows. ``at_once`` specs are submitted together; results keep the order.
    """
    overrides = overrides or {}
    if max_fit_rows is not None:
        train = bounded_rows(train, id_col, max_fit_rows)
    # every spec reads the same matrix: materialise it once (recomputable on executor loss)
    train = train.persist()
    ctx = _label_stats(train, task) | {"early_stopping": early_stopping}
    if task == "classification":
        idx = F.create_map(*[x for i, v in enumerate(ctx["classes"]) for x in (F.lit(v), F.lit(float(i)))])
        data = train.withColumn("_label", idx[F.col("label")])
    else:
        data = train.withColumn("_label", F.col("label").cast("double"))
    if early_stopping:
        data = data.withColumn("_valid", (hash32(F.col(id_col), "valid") % 10) == 0)

    def fit(spec: AlgoSpec) -> TrainedModel:
        return _fit(spec, data, ctx, id_col=id_col, override=overrides.get(spec.name, {}), weight_col=weight_col,
                    k_neighbors=k_neighbors)

    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(specs)))) as pool:
        results = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), specs))
    train.unpersist()  # fitted models no longer need it; a kNN model recomputes it from lineage
    return results
