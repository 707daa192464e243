"""Training queries (§2.9): closed-form linear family checked against SQL,
exact kNN against brute force, trees and boosting against their closed forms on one
feature."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import train as TR
from tabforge.operators.knn import knn, knn_classify, knn_regress
from tabforge.operators.score import score_models
from tabforge.operators.split import split_random
from tabforge.plans.registry import register
from tabforge.plans.standins import table

H = "CAST('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8) AS BIGINT)"

def _one_feature(spark, sf):
    """part: y = retail price, x = part key (one feature), hash split on the key."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("label"))
    sp = split_random(part, "p_partkey", 0.2)
    vec = VectorAssembler(inputCols=["p_partkey"], outputCol="features").transform(
        sp.withColumn("p_partkey", F.col("p_partkey").cast("double")))
    return vec.where(~F.col("is_test"))


def _fit_linear(spark, sf, name, decimals):
    tr = _one_feature(spark, sf)
    spec = TR.get_specs("regression", [name])[0]
    res = TR.train_all([spec], tr.withColumn("_id", F.col("p_partkey")), "regression", id_col="_id")[0]
    if not res.is_success:
        raise RuntimeError(res.error)
    m = res.model
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "coef double, intercept double").select(
        F.round("coef", decimals).alias("coef"), F.round("intercept", decimals).alias("intercept"))


def _lin_sql(coef: str, decimals: int) -> str:
    h = H.format(k="p_partkey")
    return f"""
WITH t AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y FROM part),
sp AS (SELECT *, row_number() OVER (ORDER BY {h}, p_partkey) <= (SELECT ceil(0.2 * count(*)) FROM t) AS is_test FROM t),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy
      FROM sp WHERE NOT is_test),
c AS (SELECT *, {coef} AS coef FROM s)
SELECT round(coef, {decimals}) AS coef, round(my - coef * mx, {decimals}) AS intercept FROM c"""


def _soft(a: float, extra_l2: float = 0.0) -> str:
    return (f"sign(sxy / n) * greatest(abs(sxy / n) - {a}, 0) / (sxx / n + {extra_l2})")


register("train_linear", sql=_lin_sql("sxy / sxx", 6), doc="OLS (normal equations): coefficient and intercept.")(
    lambda spark, sf: _fit_linear(spark, sf, "linear", 6))
register("train_ridge", sql=_lin_sql("sxy / (sxx + 1.0)", 6), doc="Ridge α = 1 mapped to Spark's regParam.")(
    lambda spark, sf: _fit_linear(spark, sf, "ridge", 6))
register("train_lasso", sql=_lin_sql(_soft(1.0), 4), doc="Lasso α = 1 (L1, soft threshold).")(
    lambda spark, sf: _fit_linear(spark, sf, "lasso", 4))
register("train_elastic_net", sql=_lin_sql(_soft(0.25, 0.25), 4), doc="Elastic net α = 0.5, l1_ratio = 0.5.")(
    lambda spark, sf: _fit_linear(spark, sf, "elastic_net", 4))


# Trees on one feature of few values are closed forms: a fully
# grown tree predicts the majority class or the mean of each value. Forests are held
# to a rule that the feature decides (a customer's region follows from the nation), so
# every tree that is grown to the end knows it. Boosting is a recursion per value.


def _vectors(df: DataFrame, key: str, feature: str, label: str) -> DataFrame:
    rows = df.select(key, F.array(F.col(feature).cast("double")).alias("x"), F.expr(label).alias("label"))
    rows = rows.withColumn("features", array_to_vector("x")).drop("x")
    return split_random(rows, key, 0.2)


def _customers(spark, sf, label: str) -> DataFrame:
    """Customers: nation key as the only feature."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return _vectors(table(spark, sf, "customer").join(nation, "c_nationkey"), "c_custkey", "c_nationkey", label)


def _orders(spark, sf, label: str) -> DataFrame:
    """Orders: place of the status among its values F, O, P as the only feature."""
    rows = table(spark, sf, "orders").withColumn("status", F.expr("instr('FOP', o_orderstatus) - 1"))
    return _vectors(rows, "o_orderkey", "status", label)


def _held_out(frame: DataFrame, key: str, task: str, name: str) -> DataFrame:
    """The test rows with what the fitted model says about them."""
    spec = TR.get_specs(task, [name])
    fitted = TR.train_all(spec, frame.where(~F.col("is_test")), task, id_col=key)[0]
    if not fitted.is_success:
        raise RuntimeError(f"{name} failed: {fitted.error}")
    return fitted.predict(frame.where("is_test"), key)


def _rows_sql(table_sql: str, key: str, columns: str) -> str:
    """``sp``: all rows with the split; ``tr``: the rows that models are fitted on."""
    return f"""t AS (SELECT {key}, {columns} FROM {table_sql}),
sp AS (SELECT *, row_number() OVER (ORDER BY {H.format(k=key)}, {key}) <= (SELECT ceil(0.2 * count(*)) FROM t) AS is_test FROM t),
tr AS (SELECT * FROM sp WHERE NOT is_test)"""


_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
_HIGH = "CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT)"
_HIGH_SQL = f"{_HIGH} AS y"
_STATUS_SQL = "strpos('FOP', o_orderstatus) - 1 AS x"

_RULE_SQL = f"""
WITH {_rows_sql(_CUSTOMERS, 'c_custkey', 'n_regionkey AS y')}
SELECT c_custkey, CAST(y AS DOUBLE) AS prediction FROM sp WHERE is_test"""

_MAJORITY_SQL = f"""
WITH {_rows_sql('customer', 'c_custkey', 'c_nationkey AS x, c_mktsegment AS y')},
m AS (SELECT x, y FROM tr GROUP BY x, y QUALIFY row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, y) = 1)
SELECT c_custkey, m.y AS prediction FROM sp JOIN m USING (x) WHERE is_test"""

_MEAN_SQL = f"""
WITH {_rows_sql('customer', 'c_custkey', 'c_nationkey AS x, c_acctbal AS y')},
m AS (SELECT x, avg(y) AS y FROM tr GROUP BY x)
SELECT c_custkey, round(m.y, 4) AS prediction FROM sp JOIN m USING (x) WHERE is_test"""

_BOOST_REG_SQL = f"""
WITH {_rows_sql('orders', 'o_orderkey', f'{_STATUS_SQL}, o_totalprice AS y')},
m AS (SELECT x, avg(y) AS y FROM tr GROUP BY x)
SELECT o_orderkey, round(m.y, 3) AS prediction FROM sp JOIN m USING (x) WHERE is_test"""


def _boost_clf_sql(rounds: int) -> str:
    """From the log-odds, every round adds a tenth of a Newton step of each value."""
    return f"""
WITH RECURSIVE {_rows_sql('orders', 'o_orderkey', f'{_STATUS_SQL}, {_HIGH_SQL}')},
f(x, p, i, f) AS (SELECT x, avg(y), 0, (SELECT ln(avg(y) / (1 - avg(y))) FROM tr) FROM tr GROUP BY x UNION ALL
  SELECT x, p, i + 1, f + 0.1 * (p - 1 / (1 + exp(-f))) * (1 + exp(-f)) * (1 + exp(f)) FROM f WHERE i < {rounds})
SELECT o_orderkey, CAST(f > 0 AS INT) AS prediction, round(1 / (1 + exp(-f)), 5) AS prob
FROM sp JOIN (SELECT x, f FROM f WHERE i = {rounds}) USING (x) WHERE is_test"""


_URGENCY = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END"


def _boost_three_sql(rounds: int, rate: str) -> str:
    """Three scores, moved together: each by its own Newton step under the softmax of all."""
    total = "(exp(f0) + exp(f1) + exp(f2))"
    p = [f"(exp(f{k}) / {total})" for k in range(3)]
    steps = ", ".join(f"f{k} + {rate} * (q{k} - {p[k]}) / ({p[k]} * (1 - {p[k]}))" for k in range(3))
    shares = ", ".join(f"avg((y = {k})::INT) AS q{k}" for k in range(3))
    starts = ", ".join(f"(SELECT ln(avg((y = {k})::INT)) FROM tr) AS f{k}" for k in range(3))
    probs = ", ".join(f"round({p[k]}, 5) AS prob_{k}" for k in range(3))
    return f"""
WITH RECURSIVE {_rows_sql('orders', 'o_orderkey', f'{_STATUS_SQL}, {_URGENCY} AS y')},
q AS (SELECT x, {shares} FROM tr GROUP BY x),
f AS (SELECT *, 0 AS i, {starts} FROM q UNION ALL SELECT x, q0, q1, q2, i + 1, {steps} FROM f WHERE i < {rounds})
SELECT o_orderkey, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS prediction, {probs}
FROM sp JOIN (SELECT * FROM f WHERE i = {rounds}) USING (x) WHERE is_test"""


def _logistic_sql() -> str:
    """Newton steps for slope and intercept; the slope is penalised with 1/2."""
    p = {i: f"(1 / (1 + exp(-(b + {i} * w))))" for i in range(3)}
    gb = " + ".join(f"(n{i} * {p[i]} - s{i})" for i in p)
    gw = "w + " + " + ".join(f"{i} * (n{i} * {p[i]} - s{i})" for i in p)
    h = [" + ".join(f"n{i} * {i ** k} * {p[i]} * (1 - {p[i]})" for i in p) for k in range(3)]
    sums = ", ".join(f"(count(*) FILTER (x = {i}))::DOUBLE AS n{i}, (count(*) FILTER (x = {i} AND y = 1))::DOUBLE AS s{i}" for i in p)
    return f"""
WITH RECURSIVE {_rows_sql('orders', 'o_orderkey', f'{_STATUS_SQL}, {_HIGH_SQL}')},
s AS (SELECT {sums} FROM tr),
g AS (SELECT 0 AS i, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w UNION ALL
  SELECT i + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw), w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw)
  FROM (SELECT i, b, w, {gb} AS gb, {gw} AS gw, {h[0]} AS hbb, {h[1]} AS hbw, 1 + {h[2]} AS hww FROM g, s WHERE i < 30)),
e AS (SELECT b, w FROM g WHERE i = 30)
SELECT o_orderkey, CAST(b + w * x > 0 AS INT) AS prediction, round(1 / (1 + exp(-(b + w * x))), 3) AS prob
FROM sp, e WHERE is_test"""


def _prob(pred: DataFrame, key: str, digits: int) -> DataFrame:
    return pred.select(key, "prediction", F.round(F.col("probability")[1], digits).alias("prob"))


@register("train_logistic", sql=_logistic_sql())
def q_logistic(spark, sf):
    """Logistic regression (C = 1) of high order priority on the order status."""
    return _prob(_held_out(_orders(spark, sf, _HIGH), "o_orderkey", "classification", "logistic_regression"), "o_orderkey", 3)


@register("train_decision_tree_clf", sql=_MAJORITY_SQL)
def q_tree_clf(spark, sf):
    """A fully grown tree: market segment from the nation key."""
    return _held_out(_customers(spark, sf, "c_mktsegment"), "c_custkey", "classification", "decision_tree").select(
        "c_custkey", "prediction")


@register("train_decision_tree_reg", sql=_MEAN_SQL)
def q_tree_reg(spark, sf):
    """A fully grown tree: account balance from the nation key."""
    pred = _held_out(_customers(spark, sf, "c_acctbal"), "c_custkey", "regression", "decision_tree")
    return pred.select("c_custkey", F.round("prediction", 4).alias("prediction"))


def _rule_query(task: str, name: str):
    def run(spark, sf):
        pred = _held_out(_customers(spark, sf, "n_regionkey"), "c_custkey", task, name)
        return pred.select("c_custkey", F.round(F.col("prediction").cast("double"), 6).alias("prediction"))
    run.__doc__ = f"{name} ({task}): the region of a customer from the nation key."
    return run


for _key, _task, _name in [
    ("train_random_forest_clf", "classification", "random_forest"),
    ("train_random_forest_reg", "regression", "random_forest"),
    ("train_extra_trees_clf", "classification", "extra_trees"),
    ("train_extra_trees_reg", "regression", "extra_trees"),
]:
    register(_key, sql=_RULE_SQL)(_rule_query(_task, _name))


def _boost_clf_query(name: str):
    def run(spark, sf):
        return _prob(_held_out(_orders(spark, sf, _HIGH), "o_orderkey", "classification", name), "o_orderkey", 5)
    run.__doc__ = f"{name}: high order priority from the order status."
    return run


def _boost_reg_query(name: str):
    def run(spark, sf):
        pred = _held_out(_orders(spark, sf, "o_totalprice"), "o_orderkey", "regression", name)
        return pred.select("o_orderkey", F.round("prediction", 3).alias("prediction"))
    run.__doc__ = f"{name}: total price from the order status."
    return run


def _boost_three_query(name: str):
    def run(spark, sf):
        pred = _held_out(_orders(spark, sf, _URGENCY), "o_orderkey", "classification", name)
        return pred.select("o_orderkey", "prediction", *[F.round(F.col("probability")[k], 5).alias(f"prob_{k}") for k in range(3)])
    run.__doc__ = f"{name}, three classes: how urgent an order is, from its status."
    return run


# a classical step of K scores is (K - 1) / K of Newton's
for _name, _rounds, _rate in [("gradient_boosting", 200, "0.1 * 2 / 3"), ("hist_gradient_boosting", 300, "0.1")]:
    register(f"train_{_name}_clf", sql=_boost_clf_sql(_rounds))(_boost_clf_query(_name))
    register(f"train_{_name}_multiclass", sql=_boost_three_sql(_rounds, _rate))(_boost_three_query(_name))
    register(f"train_{_name}_reg", sql=_BOOST_REG_SQL)(_boost_reg_query(_name))


# ------------------------------------------------------------------ kNN (exact, SQL-checked)


def _emb_split(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    sp = split_random(e, "vec_id", 0.2)
    return sp.where(~F.col("is_test")).drop("is_test"), sp.where(F.col("is_test")).drop("is_test")


KNN_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sp AS (SELECT *, row_number() OVER (ORDER BY {h}, vec_id) <= (SELECT ceil(0.2 * count(*)) FROM e) AS is_test FROM e),
nn AS (SELECT q.vec_id AS q_id, t.vec_id AS t_id, t.label, list_distance(q.v, t.v) AS d
       FROM sp q JOIN sp t ON q.is_test AND NOT t.is_test
       QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) <= 5),
wz AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id) AS hz FROM nn),
w AS (SELECT q_id, label, CASE WHEN hz = 1 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END AS w FROM wz)
""".replace("{h}", H.format(k="vec_id"))


@register("train_kneighbors_clf", sql=KNN_SQL + """,
v AS (SELECT q_id, label, sum(w) AS vw FROM w GROUP BY q_id, label)
SELECT q_id AS vec_id, label AS prediction FROM v
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY vw DESC, label) = 1""")
def q_knn_clf(spark, sf):
    """5-NN classifier, inverse-distance votes (ties → smaller class), exact neighbours."""
    tr, te = _emb_split(spark, sf)
    nn = knn(te.select(F.col("vec_id").alias("id"), "vec"), tr.select(F.col("vec_id").alias("id"), "vec"), 5,
             id_col="id", vec_col="vec")
    pred = knn_classify(nn, tr.select(F.col("vec_id").alias("t_id"), "label"), "label")
    return pred.select(F.col("q_id").alias("vec_id"), "prediction")


@register("train_kneighbors_reg", sql=KNN_SQL + """
SELECT q_id AS vec_id, round(sum(w * label) / sum(w), 9) AS prediction FROM w GROUP BY q_id""")
def q_knn_reg(spark, sf):
    """5-NN regressor: inverse-distance weighted mean of the neighbours' targets."""
    tr, te = _emb_split(spark, sf)
    nn = knn(te.select(F.col("vec_id").alias("id"), "vec"), tr.select(F.col("vec_id").alias("id"), "vec"), 5,
             id_col="id", vec_col="vec")
    pred = knn_regress(nn, tr.select(F.col("vec_id").alias("t_id"), F.col("label").cast("double").alias("target")))
    return pred.select(F.col("q_id").alias("vec_id"), F.round("prediction", 9).alias("prediction"))


# ------------------------------------------------------------------ all specs

# Whether a customer lives in region 2, from the nation key: all but the linear model
# learn it; that one ranks by the nation key and says no to everyone.
_PRESENT = "CAST(n_regionkey = 2 AS INT)"
_ALL_SQL = f"""
WITH {_rows_sql(_CUSTOMERS, 'c_custkey', f'c_nationkey AS x, {_PRESENT} AS y')},
sign AS (SELECT covar_pop(x, y) > 0 AS up FROM tr),
by_x AS (SELECT x, (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS n FROM sp WHERE is_test GROUP BY x),
area AS (SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS a FROM (
  SELECT *, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_x)),
linear AS (SELECT 1 - avg(y) AS accuracy FROM sp WHERE is_test),
algo(i, algo) AS (VALUES {', '.join(f"({i}, '{s.name}')" for i, s in enumerate(TR.CLASSIFICATION_SPECS))}),
m AS (
  SELECT i, algo, 'accuracy' AS metric, CASE i WHEN 0 THEN accuracy ELSE 1 END AS value FROM algo, linear UNION ALL
  SELECT i, algo, 'f1', CASE i WHEN 0 THEN 0 ELSE 1 END FROM algo UNION ALL
  SELECT i, algo, 'roc_auc', CASE i WHEN 0 THEN CASE WHEN up THEN a ELSE 1 - a END ELSE 1 END FROM algo, area, sign)"""


def _train_all(spark, sf):
    frame = _customers(spark, sf, _PRESENT)
    trained = TR.train_all(TR.get_specs("classification"), frame.where(~F.col("is_test")), "classification",
                           id_col="c_custkey")
    return frame.where("is_test").drop("is_test"), trained


@register("train_all", sql=_ALL_SQL + """
SELECT i AS "order", algo, 'success' AS status, round(value, 6) AS accuracy FROM m WHERE metric = 'accuracy'""")
def q_train_all(spark, sf):
    """Every classification spec in registry order on one cached matrix; failures isolated; held-out accuracy."""
    test, trained = _train_all(spark, sf)
    scores = score_models(trained, test, "classification", id_col="c_custkey").where("metric = 'accuracy' or metric is null")
    return scores.select("order", "algo", "status", F.round("value", 6).alias("accuracy"))


@register("score_models", sql=_ALL_SQL + """
SELECT algo, i AS "order", 'success' AS status, metric, round(value, 6) AS value, NULL::VARCHAR AS error FROM m""")
def q_score_models(spark, sf):
    """Metrics (accuracy, f1, roc_auc) of every trained model on the test split, long format."""
    test, trained = _train_all(spark, sf)
    scores = score_models(trained, test, "classification", id_col="c_custkey").drop("train_time_ms")
    return scores.withColumn("value", F.round("value", 6))
