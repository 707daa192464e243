"""Scoring trained models: metrics per model, batch prediction with class
probability columns, top-k classes, unseen-category warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.columns import q
from tabforge.operators import metrics as M
from tabforge.operators.preprocess import PreprocessorModel, validate_scoring_input
from tabforge.operators.split import class_counts
from tabforge.operators.train import TrainedModel, assemble
from tabforge.plans.config import FeatureSchema

UNSEEN_EXAMPLES = 10
RESULT_PREVIEW_ROWS = 1000


def score_models(trained: Sequence[TrainedModel], test: DataFrame, task: str, *, id_col: str) -> DataFrame:
    """Long table (algo, order, status, metric, value, error, train_time_ms).
    A model whose scoring fails becomes ``failed`` with ``scoring failed: …``."""
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task_type: {task}")
    spark = test.sparkSession
    rows = []
    labels = test.select(id_col, "label")
    y_classes = None
    if task == "classification":
        y_classes = [c for c, _ in class_counts(labels, "label")]
    for order, t in enumerate(trained):
        if not t.is_success:
            rows.append((t.name, order, "failed", None, None, t.error, t.train_time_ms))
            continue
        pred = None
        try:
            # one prediction pass per model, reused by every metric (one row per test row)
            pred = t.predict(test, id_col, keep=["label"]).persist()
            if task == "classification":
                mets = {}
                if len(y_classes) == 2:
                    pos = M.positive_label(y_classes)
                    mets["accuracy"], mets["f1"] = M.accuracy_f1_binary(pred, "label", "prediction", pos)
                    if "probability" in pred.columns and pos in t.classes:
                        pi = t.classes.index(pos)
                        auc = M.roc_auc_binary(pred.withColumn("_s", F.col("probability")[pi]), "label", "_s", pos)
                        if auc is not None and len(t.classes) == 2:
                            mets["roc_auc"] = auc
                else:
                    mets["accuracy"] = M.accuracy(pred, "label", "prediction")
                    mets["f1"] = M.f1_macro(pred, "label", "prediction")
                    if "probability" in pred.columns:
                        proba = {}
                        for i, c in enumerate(t.classes):
                            pred = pred.withColumn(f"_p{i}", F.col("probability")[i])
                            proba[c] = f"_p{i}"
                        auc = M.roc_auc_ovr_df(pred, "label", proba).first()["roc_auc"]
                        if auc is not None:
                            mets["roc_auc"] = auc
            else:
                r = M.regression_metrics_df(pred, "label", "prediction").first()
                mets = {"rmse": r["rmse"], "mae": r["mae"], "r2": r["r2"]}
            for m, v in mets.items():
                rows.append((t.name, order, "success", m, None if v is None else float(v), None, t.train_time_ms))
        except Exception as e:  # noqa: BLE001 — scoring one model must not stop the others
            rows.append((t.name, order, "failed", None, None, f"scoring failed: {e}", t.train_time_ms))
        finally:
            if pred is not None:
                pred.unpersist()
    schema = "algo string, order int, status string, metric string, value double, error string, train_time_ms long"
    return spark.createDataFrame(rows, schema)


def plot_data(model: TrainedModel, test: DataFrame, *, id_col: str) -> DataFrame:
    """What a model's plot shows: its confusion matrix, or a sample of (true, predicted) values."""
    pred = model.predict(test, id_col, keep=["label"])
    if model.task == "classification":
        return M.confusion_matrix(pred, "label", "prediction")
    return M.scatter_sample(pred, "label", "prediction", [id_col])


def model_status(scores: DataFrame) -> DataFrame:
    """One row per model (algo, order, status)."""
    return scores.groupBy("algo", "order").agg(F.min("status").alias("status"))


def predict_batch(model: TrainedModel, pre: PreprocessorModel, schema: FeatureSchema, table: DataFrame, *, id_col: str,
                  with_proba: bool = True) -> DataFrame:
    """Every column of ``table``, then ``prediction`` (and one ``prob_<class>`` per class).

    Validates the input columns, applies the fitted preprocessing and the model in one
    projection; the table's own columns ride along. Columns of the table that are named
    like an output are replaced.
    """
    held = {c: f"__column_{i}" for i, c in enumerate(table.columns)}
    wide = table.select("*", *[q(c).alias(h) for c, h in held.items()])
    inputs, _ = validate_scoring_input(wide, schema, keep=list(held.values()))
    matrix = assemble(pre.transform(inputs, keep=list(held.values())), pre.output_columns)
    pred = model.predict(matrix, held[id_col], keep=[h for c, h in held.items() if c != id_col])
    scores = {"prediction": F.col("prediction")}
    if with_proba and "probability" in pred.columns:
        scores |= {f"prob_{c}": F.col("probability")[i] for i, c in enumerate(model.classes)}
    return pred.select(*[F.col(h).alias(c) for c, h in held.items() if c not in scores],
                       *[value.alias(name) for name, value in scores.items()])


def topk_proba(pred: DataFrame, classes: Sequence, *, id_col: str, k: int = 3) -> DataFrame:
    """(id, rank, class, prob): the k most likely classes (ties → smaller class)."""
    items = F.array(*[F.struct(F.lit(-1.0) * F.col("probability")[i], F.lit(str(c)).alias("cls"),
                               F.col("probability")[i].alias("prob")) for i, c in enumerate(classes)])
    top = F.slice(F.array_sort(items), 1, k)
    return pred.select(id_col, F.posexplode(top).alias("rank", "t")).select(
        id_col, (F.col("rank") + 1).alias("rank"), F.col("t.cls").alias("class"), F.col("t.prob").alias("prob"))


def warn_unseen_categories(scoring: DataFrame, vocab: DataFrame, cols: Sequence[str],
                           max_examples: int = UNSEEN_EXAMPLES) -> DataFrame:
    """Per categorical column: count of values absent from the training vocabulary
    and the first ``max_examples`` of them (sorted), '...' appended when more.
    ``vocab``: (column, value). Distinct values are anti-joined, then a per-column
    top-k (WindowGroupLimit) picks the examples."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])
    seen = scoring.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    unseen = seen.join(vocab.select("column", "value"), on=["column", "value"], how="left_anti")
    w = Window.partitionBy("column").orderBy("value")
    top = unseen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_examples + 1)
    agg = top.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "value"))).alias("_v"), F.max("_rn").alias("_m"))
    counts = unseen.groupBy("column").agg(F.count(F.lit(1)).alias("n_unseen"))
    ex = F.array_join(F.transform(F.slice("_v", 1, max_examples), lambda s: s["value"]), ", ")
    return agg.join(counts, on="column").select(
        "column", "n_unseen",
        F.when(F.col("_m") > max_examples, F.concat(ex, F.lit(", ..."))).otherwise(ex).alias("examples"))


def result_preview(pred: DataFrame, order_cols: Sequence[str], n: int = RESULT_PREVIEW_ROWS) -> DataFrame:
    return pred.orderBy(*order_cols).limit(n)
