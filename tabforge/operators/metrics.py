"""Classification and regression metrics as aggregations.

Each metric is one aggregate (or a fixed number of them) over the scored rows;
nothing is collected except the final numbers. ROC AUC groups rows by score
first and uses distributed prefix sums, so ties get the usual half credit and
no single task sees all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.stats import with_position, with_prefix_sums

# Fixed values (reference): metric directions and default metric sets.
METRIC_DIRECTIONS = {"accuracy": "max", "f1": "max", "roc_auc": "max", "rmse": "min", "mae": "min", "r2": "max"}
CLASSIFICATION_METRICS = ("accuracy", "f1", "roc_auc")
REGRESSION_METRICS = ("rmse", "mae", "r2")
SCATTER_MAX_POINTS = 2000
MAX_DENSE_LABELS = 10_000


def accuracy(df: DataFrame, y: str, p: str) -> float | None:
    r = df.agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("a")).first()
    return r["a"]


def positive_label(labels: Sequence) -> object:
    """Positive class for binary f1: 1 when present, else the larger label."""
    if 1 in labels or "1" in labels:
        return 1 if 1 in labels else "1"
    return sorted(labels, key=lambda v: str(v))[-1]


def accuracy_f1_binary(df: DataFrame, y: str, p: str, pos) -> tuple[float | None, float]:
    """Accuracy and binary F1 from one aggregate."""
    yp, pp = F.col(y) == F.lit(pos), F.col(p) == F.lit(pos)
    r = df.agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("acc"),
               F.count_if(yp & pp).alias("tp"), F.count_if(~yp & pp).alias("fp"),
               F.count_if(yp & ~pp).alias("fn")).first()
    d = 2 * r["tp"] + r["fp"] + r["fn"]
    return r["acc"], (0.0 if d == 0 else 2 * r["tp"] / d)


def f1_binary(df: DataFrame, y: str, p: str, pos) -> float:
    yp, pp = F.col(y) == F.lit(pos), F.col(p) == F.lit(pos)
    r = df.agg(F.count_if(yp & pp).alias("tp"), F.count_if(~yp & pp).alias("fp"),
               F.count_if(yp & ~pp).alias("fn")).first()
    d = 2 * r["tp"] + r["fp"] + r["fn"]
    return 0.0 if d == 0 else 2 * r["tp"] / d


def per_label_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn) over the union of true and predicted labels."""
    pairs = df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).count()
    same = F.col("y") == F.col("p")
    rows = pairs.select(F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.when(same, F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(~same, F.col("count")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(~same, F.col("count")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )))
    return rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def f1_macro_df(df: DataFrame, y: str, p: str) -> DataFrame:
    c = per_label_counts(df, y, p)
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(d == 0, 0.0).otherwise(2 * F.col("tp") / d)
    return c.agg(F.avg(f1).alias("f1"))


def f1_macro(df: DataFrame, y: str, p: str) -> float:
    return float(f1_macro_df(df, y, p).first()["f1"])


def auc_by_group(df: DataFrame, group_cols: Sequence[str], is_pos, score) -> DataFrame:
    """ROC AUC per group: rows grouped by score, negatives below each score by
    prefix sums; ties count one half. NULL when a group lacks a class."""
    g = list(group_cols)
    grouped = df.groupBy(*g, score.cast("double").alias("_s")).agg(
        F.count_if(is_pos).alias("_pos"), F.count_if(~is_pos).alias("_neg"))
    pref = with_prefix_sums(grouped, g, "_s", ["_neg"])
    out = pref.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_neg_before") + 0.5 * F.col("_neg"))).alias("_num"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    # guard inside CASE WHEN: under ANSI mode a zero divisor would raise
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*g, F.when(ok, F.col("_num") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def roc_auc_binary(df: DataFrame, y: str, score: str, pos) -> float | None:
    df2 = df.withColumn("_g", F.lit(0))
    r = auc_by_group(df2, ["_g"], F.col(y) == F.lit(pos), F.col(score)).first()
    return None if r is None else r["auc"]


def roc_auc_ovr_df(df: DataFrame, y: str, proba: dict) -> DataFrame:
    """Macro one-vs-rest AUC; NULL when the true labels do not cover exactly the
    scored classes (the metric is then omitted, as in the reference)."""
    items = F.array(*[F.struct(F.lit(str(k)).alias("_cls"), F.col(c).cast("double").alias("_score"))
                      for k, c in proba.items()])
    long = df.select(F.col(y).cast("string").alias("_y"), F.inline(items))
    per = auc_by_group(long, ["_cls"], F.col("_y") == F.col("_cls"), F.col("_score"))
    k = df.agg(F.count_distinct(F.col(y).cast("string"))).scalar()
    outside = df.agg(F.count_if(~F.col(y).cast("string").isin([str(c) for c in proba]))).scalar()
    agg = per.agg(F.avg("auc").alias("auc"), F.count_if(F.col("auc").isNull()).alias("undef"))
    return agg.select(
        F.when((F.col("undef") == 0) & (k == len(proba)) & (outside == 0), F.col("auc")).alias("roc_auc"))


def regression_metrics_df(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y).cast("double") - F.col(p).cast("double")
    yy = F.col(y).cast("double")
    # Spark's var_pop merges partial moments stably; SST = var_pop · n.
    j = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
               (F.var_pop(yy) * F.count(yy)).alias("sst"))
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.col("sse") / F.col("sst"))
    return j.select(F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence | None = None, dense: bool | None = None) -> DataFrame:
    """(row_idx, col_idx, true_label, pred_label, count) over the label set: the string-sorted union of true and
    predicted labels unless given. Rows with a missing label, or one outside a given list, are left out.

    ``dense`` adds the pairs that do not occur, with count 0; by default up to ``MAX_DENSE_LABELS`` labels. Above
    that the pairs that occur are the matrix: there are no more of them than rows.
    """
    counts = df.groupBy(F.col(y).cast("string").alias("true_label"), F.col(p).cast("string").alias("pred_label")).count()
    if labels is None:
        seen = counts.select(F.explode(F.array("true_label", "pred_label")).alias("label")).where(F.col("label").isNotNull())
        lab = with_position(seen.distinct(), [], ["label"], out="idx").select("label", "idx")
    else:
        lab = df.sparkSession.createDataFrame([(str(v), i) for i, v in enumerate(labels)], "label string, idx bigint")
    n = lab.count()
    true = lab.select(F.col("label").alias("true_label"), F.col("idx").cast("bigint").alias("row_idx"))
    pred = lab.select(F.col("label").alias("pred_label"), F.col("idx").cast("bigint").alias("col_idx"))
    columns = ("row_idx", "col_idx", "true_label", "pred_label")
    if dense is False or (dense is None and n > MAX_DENSE_LABELS):
        return counts.join(true, "true_label").join(pred, "pred_label").select(*columns, "count")
    cells = df.sparkSession.range(n * n).select(F.expr(f"id div {max(n, 1)}").alias("row_idx"), (F.col("id") % max(n, 1)).alias("col_idx"))
    return cells.join(true, "row_idx").join(pred, "col_idx").join(counts, ["true_label", "pred_label"], "left").select(
        *columns, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def scatter_sample(df: DataFrame, y: str, p: str, order_cols: Sequence[str], max_points: int = SCATTER_MAX_POINTS
                   ) -> DataFrame:
    """(y, p) pairs; above ``max_points`` rows keep every (n div max)-th row in
    order, at most ``max_points`` of them. Positions come from range partitioning."""
    n = df.count()
    pos = with_position(df.select(*order_cols, y, p), [], list(order_cols), out="pos")
    if n <= max_points:
        return pos.select("pos", F.col(y).alias("y_true"), F.col(p).alias("y_pred"))
    step = max(1, n // max_points)
    return pos.where((F.col("pos") % step == 0) & (F.col("pos") / step < max_points)).select(
        "pos", F.col(y).alias("y_true"), F.col(p).alias("y_pred"))


def scatter_bounds(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.least(F.min(y), F.min(p)).cast("double").alias("lo"),
                  F.greatest(F.max(y), F.max(p)).cast("double").alias("hi"))


# --------------------------------------------------------------------- model ranking


def _direction(metric_key: str) -> str:
    d = METRIC_DIRECTIONS.get(metric_key)
    if d is None:
        raise ValueError(f"unknown metric: {metric_key}")
    return d


def select_best(scores: DataFrame, metric_key: str) -> DataFrame:
    """Best successful model having ``metric_key`` (direction from the table;
    ties → first in order). ``scores``: algo, order, status, metric, value."""
    sign = 1.0 if _direction(metric_key) == "max" else -1.0
    cand = scores.where((F.col("status") == "success") & (F.col("metric") == metric_key) & F.col("value").isNotNull())
    key = F.struct((F.col("value") * sign).alias("v"), (-F.col("order")).alias("o"))
    return cand.agg(F.max_by(F.struct("algo", "value"), key).alias("b")).where(F.col("b").isNotNull()).select(
        F.col("b.algo").alias("algo"), F.col("b.value").alias(metric_key))


def leaderboard(scores: DataFrame, models: DataFrame, metric_key: str, metrics: Sequence[str]) -> DataFrame:
    """One row per model: successes by the main metric (direction-aware, stable
    by order), failures last; metric columns with the main metric first; best flag.
    ``models``: algo, order, status. Rows = models (small)."""
    direction = _direction(metric_key)
    cols = [metric_key] + [m for m in metrics if m != metric_key]
    wide = scores.groupBy("algo").pivot("metric", cols).agg(F.first("value"))
    lb = models.join(wide, on="algo", how="left")
    main = F.col(metric_key)
    okey = main.desc_nulls_last() if direction == "max" else main.asc_nulls_last()
    failed_last = F.when(F.col("status") == "success", 0).otherwise(1)
    w = Window.orderBy(failed_last, okey, F.col("order"))  # one row per model
    best = select_best(scores, metric_key).select(F.col("algo").alias("_best"))
    return (lb.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .join(best, on=F.col("algo") == F.col("_best"), how="left")
            .withColumn("is_best", F.col("_best").isNotNull()).drop("_best")
            .select("rank", "algo", "status", *cols, "is_best"))
