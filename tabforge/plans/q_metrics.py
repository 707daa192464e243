"""Metric queries on rule-based predictions (§2.10), checked digit by digit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import metrics as M
from tabforge.plans.registry import register
from tabforge.plans.standins import standin, with_standins

R = 9  # decimals kept in metric outputs


def _cls(spark, sf):
    return standin(spark, sf, "s_cls")


def _mc(spark, sf):
    return standin(spark, sf, "s_mc")


def _reg(spark, sf):
    return standin(spark, sf, "s_reg")


def _one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _round(v):
    return None if v is None else round(float(v), R)


@register("metric_accuracy", sql=with_standins(["s_cls", "s_mc"], f"""
SELECT 'binary' AS task, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), {R}) AS accuracy FROM s_cls
UNION ALL SELECT 'multiclass', round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), {R}) FROM s_mc"""))
def q_accuracy(spark, sf):
    """Share of equal labels, binary and multiclass."""
    a = M.accuracy(_cls(spark, sf), "y", "p")
    b = M.accuracy(_mc(spark, sf), "y", "p")
    return _one(spark, [("binary", a), ("multiclass", b)], "task string, accuracy double").select(
        "task", F.round("accuracy", R).alias("accuracy"))


@register("metric_f1_binary", sql=with_standins(["s_cls"], f"""
SELECT round(CASE WHEN d = 0 THEN 0.0 ELSE 2.0 * tp / d END, {R}) AS f1 FROM (
  SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
         2 * count(*) FILTER (WHERE y = 1 AND p = 1) + count(*) FILTER (WHERE y <> 1 AND p = 1)
           + count(*) FILTER (WHERE y = 1 AND p <> 1) AS d FROM s_cls)"""))
def q_f1_binary(spark, sf):
    """Binary F1 with positive class 1 (0/0 → 0)."""
    return _one(spark, [(M.f1_binary(_cls(spark, sf), "y", "p", 1),)], "f1 double").select(F.round("f1", R).alias("f1"))


@register("metric_f1_macro", sql=with_standins(["s_mc"], f""",
pairs AS (SELECT CAST(y AS VARCHAR) AS y, CAST(p AS VARCHAR) AS p, count(*) AS c FROM s_mc GROUP BY 1, 2),
lab AS (SELECT y AS l FROM pairs UNION SELECT p FROM pairs),
per AS (SELECT l, sum(CASE WHEN y = l AND p = l THEN c ELSE 0 END) AS tp,
               sum(CASE WHEN y <> l AND p = l THEN c ELSE 0 END) AS fp,
               sum(CASE WHEN y = l AND p <> l THEN c ELSE 0 END) AS fn FROM lab, pairs GROUP BY l)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), {R}) AS f1 FROM per"""))
def q_f1_macro(spark, sf):
    """Macro F1 over the union of true and predicted labels."""
    return M.f1_macro_df(_mc(spark, sf), "y", "p").select(F.round("f1", R).alias("f1"))


_AUC_SQL = """
g AS (SELECT {grp}score, count(*) FILTER (WHERE {pos}) AS pos, count(*) FILTER (WHERE NOT ({pos})) AS neg
      FROM {src} GROUP BY {grp}score),
c AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS nb FROM g),
a AS (SELECT {grp}sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c {gb})"""


@register("metric_roc_auc_binary", sql=with_standins(["s_cls"], "," + _AUC_SQL.format(
    grp="", pos="y = 1", src="s_cls", part="", gb="") + f"\nSELECT round(auc, {R}) AS roc_auc FROM a"))
def q_auc_binary(spark, sf):
    """Binary ROC AUC with tie correction (score groups + prefix sums)."""
    v = M.roc_auc_binary(_cls(spark, sf), "y", "score", 1)
    return _one(spark, [(v,)], "roc_auc double").select(F.round("roc_auc", R).alias("roc_auc"))


_OVR_LONG = " UNION ALL ".join(f"SELECT CAST(y AS VARCHAR) AS y, '{i}' AS cls, s{i} AS score FROM s_mc"
                               for i in range(10))


@register("metric_roc_auc_ovr", sql=with_standins(["s_mc"], f""",
lg AS ({_OVR_LONG}),""" + _AUC_SQL.format(grp="cls, ", pos="y = cls", src="lg", part="PARTITION BY cls ",
                                          gb="GROUP BY cls") + f"\nSELECT round(avg(auc), {R}) AS roc_auc FROM a"))
def q_auc_ovr(spark, sf):
    """Macro one-vs-rest ROC AUC over ten class scores."""
    proba = {i: f"s{i}" for i in range(10)}
    return M.roc_auc_ovr_df(_mc(spark, sf), "y", proba).select(F.round("roc_auc", R).alias("roc_auc"))


@register("metric_rmse", sql=with_standins(["s_reg"], "SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM s_reg"))
def q_rmse(spark, sf):
    """Root mean squared error."""
    return M.regression_metrics_df(_reg(spark, sf), "y", "p").select(F.round("rmse", 6).alias("rmse"))


@register("metric_mae", sql=with_standins(["s_reg"], "SELECT round(avg(abs(y - p)), 6) AS mae FROM s_reg"))
def q_mae(spark, sf):
    """Mean absolute error."""
    return M.regression_metrics_df(_reg(spark, sf), "y", "p").select(F.round("mae", 6).alias("mae"))


@register("metric_r2", sql=with_standins(["s_reg"], f"""
SELECT round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END, {R}) AS r2 FROM (
  SELECT sum((y - p) * (y - p)) AS sse, var_pop(y) * count(y) AS sst FROM s_reg)"""))
def q_r2(spark, sf):
    """Coefficient of determination 1 − SSE/SST (constant target: 1 if perfect else 0)."""
    return M.regression_metrics_df(_reg(spark, sf), "y", "p").select(F.round("r2", R).alias("r2"))


@register("confusion_matrix", sql=with_standins(["s_mc"], """,
lab AS (SELECT CAST(y AS VARCHAR) AS l FROM s_mc UNION SELECT CAST(p AS VARCHAR) FROM s_mc),
idx AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i FROM lab),
cnt AS (SELECT CAST(y AS VARCHAR) AS t, CAST(p AS VARCHAR) AS pr, count(*) AS c FROM s_mc GROUP BY 1, 2)
SELECT a.i AS row_idx, b.i AS col_idx, a.l AS true_label, b.l AS pred_label, CAST(coalesce(c, 0) AS BIGINT) AS count
FROM idx a CROSS JOIN idx b LEFT JOIN cnt ON cnt.t = a.l AND cnt.pr = b.l"""))
def q_confusion(spark, sf):
    """Dense confusion matrix over string-sorted labels (zeros included)."""
    return M.confusion_matrix(_mc(spark, sf), "y", "p")


@register("scatter_sample", sql=with_standins(["s_reg"], """,
r AS (SELECT row_number() OVER (ORDER BY l_orderkey, y) - 1 AS pos, y, p FROM s_reg),
n AS (SELECT count(*) AS n FROM s_reg)
SELECT pos, y AS y_true, p AS y_pred FROM r, n
WHERE n <= 2000 OR (pos % (n // 2000) = 0 AND pos / (n // 2000) < 2000)"""))
def q_scatter_sample(spark, sf):
    """Every (n div 2000)-th (y, p) pair in key order, at most 2000."""
    return M.scatter_sample(_reg(spark, sf), "y", "p", ["l_orderkey", "y"])


@register("scatter_bounds", sql=with_standins(["s_reg"], """
SELECT CAST(least(min(y), min(p)) AS DOUBLE) AS lo, CAST(greatest(max(y), max(p)) AS DOUBLE) AS hi FROM s_reg"""))
def q_scatter_bounds(spark, sf):
    """Range of the y = x reference line."""
    return M.scatter_bounds(_reg(spark, sf), "y", "p")


_RULE_MODELS = [("m_rule", "p"), ("m_exact", "p_exact"), ("m_parity", "p_parity")]


def _rule_scores(spark, sf):
    cls = _cls(spark, sf)
    rows, models = [], []
    for i, (algo, col) in enumerate(_RULE_MODELS):
        rows.append((algo, i, "success", "accuracy", M.accuracy(cls, "y", col)))
        rows.append((algo, i, "success", "f1", M.f1_binary(cls, "y", col, 1)))
        models.append((algo, i, "success"))
    models.append(("m_fail", len(_RULE_MODELS), "failed"))
    scores = spark.createDataFrame(rows, "algo string, order int, status string, metric string, value double")
    return scores.withColumn("value", F.round("value", R)), spark.createDataFrame(models, "algo string, order int, status string")


_SC_SQL = "," + ",\n".join([f"""sc{i} AS (SELECT '{a}' AS algo, {i} AS ord, 'success' AS status,
  round(avg(CASE WHEN y = {c} THEN 1.0 ELSE 0.0 END), {R}) AS accuracy,
  round(CASE WHEN 2 * count(*) FILTER (WHERE y = 1 AND {c} = 1) + count(*) FILTER (WHERE y <> 1 AND {c} = 1)
        + count(*) FILTER (WHERE y = 1 AND {c} <> 1) = 0 THEN 0.0 ELSE
        2.0 * count(*) FILTER (WHERE y = 1 AND {c} = 1) / (2 * count(*) FILTER (WHERE y = 1 AND {c} = 1)
        + count(*) FILTER (WHERE y <> 1 AND {c} = 1) + count(*) FILTER (WHERE y = 1 AND {c} <> 1)) END, {R}) AS f1
  FROM s_cls)""" for i, (a, c) in enumerate(_RULE_MODELS)]) + """,
sc AS (SELECT * FROM sc0 UNION ALL SELECT * FROM sc1 UNION ALL SELECT * FROM sc2
       UNION ALL SELECT 'm_fail', 3, 'failed', NULL, NULL),
best AS (SELECT algo FROM sc WHERE status = 'success' AND f1 IS NOT NULL ORDER BY f1 DESC, ord LIMIT 1)"""


@register("select_best", sql=with_standins(["s_cls"], _SC_SQL + "\nSELECT algo, f1 FROM sc WHERE algo IN (SELECT algo FROM best)"))
def q_select_best(spark, sf):
    """Best successful model by f1 (direction table; ties → first; failures skipped)."""
    scores, _ = _rule_scores(spark, sf)
    return M.select_best(scores, "f1")


@register("leaderboard", sql=with_standins(["s_cls"], _SC_SQL + """
SELECT row_number() OVER (ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, f1 DESC NULLS LAST, ord) AS rank,
       algo, status, f1, accuracy, algo IN (SELECT algo FROM best) AS is_best FROM sc"""))
def q_leaderboard(spark, sf):
    """Models ranked by f1 (failures last), metric columns main-first, best flagged."""
    scores, models = _rule_scores(spark, sf)
    return M.leaderboard(scores, models, "f1", ["accuracy", "f1"])
