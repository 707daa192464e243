"""Batch scoring queries (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import preprocess as PP
from tabforge.operators import score as SC
from tabforge.operators import train as TR
from tabforge.operators.knn import knn, knn_classify
from tabforge.operators.profile import category_vocab
from tabforge.operators.split import split_random
from tabforge.plans.config import FeatureSchema, PreprocessingConfig
from tabforge.plans.q_train import KNN_SQL, H, _emb_split
from tabforge.plans.registry import register
from tabforge.plans.standins import table
from tabforge.session import scratch_path
from tabforge.sources import bundle as BD

CUTOFF = "1999-01-01 00:00:00"


def scoring_bundle(spark, sf) -> str:
    """Path of a bundle: the retail price as a line over the part key, trained and saved."""
    part = table(spark, sf, "part")
    train = split_random(part.select("p_partkey", "p_retailprice"), "p_partkey", 0.2).where(~F.col("is_test"))
    config = PreprocessingConfig(numeric_scale="none")
    pre = PP.Preprocessor(config, ["p_partkey"], []).fit(train)
    numbered = train.withColumn("id", F.col("p_partkey"))
    matrix = TR.assemble(pre.transform(numbered, keep=["id", "p_retailprice"]), pre.output_columns)
    fitted = TR.train_all(TR.get_specs("regression", ["linear"]), matrix.withColumnRenamed("p_retailprice", "label"),
                          "regression", id_col="id")[0]
    if not fitted.is_success:
        raise RuntimeError(fitted.error)
    schema = FeatureSchema(numeric=("p_partkey",), categorical=(), target="p_retailprice")
    return BD.save_bundle(spark, scratch_path(spark, "bundle"), model=fitted, pre=pre, schema=schema, metrics={},
                          config=config)


def _batch(spark, sf):
    """Train, save, load, then score every part row with what was loaded."""
    model, pre, schema, *_ = BD.load_bundle(spark, scoring_bundle(spark, sf))
    out = SC.predict_batch(model, pre, schema, table(spark, sf, "part"), id_col="p_partkey")
    return out.withColumn("prediction", F.round("prediction", 6))


_BATCH_SQL = f"""
WITH t AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y FROM part),
sp AS (SELECT *, row_number() OVER (ORDER BY {H.format(k='p_partkey')}, p_partkey)
                 <= (SELECT ceil(0.2 * count(*)) FROM t) AS is_test FROM t),
s AS (SELECT avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / regr_sxx(y, x) AS coef FROM sp WHERE NOT is_test)
SELECT part.*, round(my - coef * mx + coef * CAST(p_partkey AS DOUBLE), 6) AS prediction FROM part, s"""


@register("predict_batch", sql=_BATCH_SQL)
def q_predict_batch(spark, sf):
    """Original part columns + prediction of a trained linear model."""
    return _batch(spark, sf)


@register("result_preview", sql=_BATCH_SQL + " ORDER BY p_partkey LIMIT 1000")
def q_result_preview(spark, sf):
    """First 1000 scored rows in key order."""
    return SC.result_preview(_batch(spark, sf), ["p_partkey"])


def _knn_probs(spark, sf):
    tr, te = _emb_split(spark, sf)
    classes = sorted(r["label"] for r in tr.select("label").distinct().collect())  # one row per class
    nn = knn(te.select(F.col("vec_id").alias("id"), "vec"), tr.select(F.col("vec_id").alias("id"), "vec"), 5,
             id_col="id", vec_col="vec")
    pred = knn_classify(nn, tr.select(F.col("vec_id").alias("t_id"), "label"), "label")
    probs = F.array(*[F.coalesce(F.col("probs")[str(c)], F.lit(0.0)) for c in classes])
    return pred.select(F.col("q_id").alias("vec_id"), "prediction", probs.alias("probability")), classes


_PROBS_SQL = KNN_SQL + """,
cls AS (SELECT DISTINCT label AS c FROM sp WHERE NOT is_test),
qs AS (SELECT DISTINCT q_id FROM w),
v AS (SELECT q_id, label, sum(w) AS vw FROM w GROUP BY q_id, label),
tot AS (SELECT q_id, sum(vw) AS t FROM v GROUP BY q_id),
pr AS (SELECT qs.q_id, cls.c, coalesce(v.vw, 0) / tot.t AS p FROM qs CROSS JOIN cls
       LEFT JOIN v ON v.q_id = qs.q_id AND v.label = cls.c JOIN tot ON tot.q_id = qs.q_id)"""


@register("proba_columns", sql=_PROBS_SQL + "\nSELECT q_id AS vec_id, " + ", ".join(
    f"round(max(CASE WHEN c = {i} THEN p END), 9) AS prob_{i}" for i in range(10)) + " FROM pr GROUP BY q_id")
def q_proba_columns(spark, sf):
    """One prob_<class> column per class from the kNN classifier."""
    pred, classes = _knn_probs(spark, sf)
    return pred.select("vec_id", *[F.round(F.col("probability")[i], 9).alias(f"prob_{c}") for i, c in enumerate(classes)])


@register("topk_proba", sql=_PROBS_SQL + """
SELECT q_id AS vec_id, rank, CAST(c AS VARCHAR) AS class, round(p, 9) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, CAST(c AS VARCHAR)) AS rank FROM pr)
WHERE rank <= 3""")
def q_topk_proba(spark, sf):
    """Three most likely classes per scored row."""
    pred, classes = _knn_probs(spark, sf)
    top = SC.topk_proba(pred, classes, id_col="vec_id", k=3)
    return top.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "class", F.round("prob", 9).alias("prob"))


@register("warn_unseen_categories", sql=f"""
WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}'),
sc AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'),
v AS (SELECT 'o_orderpriority' AS col, o_orderpriority AS value FROM tr
      UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM tr),
s AS (SELECT 'o_orderpriority' AS col, o_orderpriority AS value FROM sc
      UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM sc),
u AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.col = s.col AND v.value = s.value)),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) AS rn, count(*) OVER (PARTITION BY col) AS n FROM u)
SELECT col AS "column", n AS n_unseen,
       string_agg(value, ', ' ORDER BY value) FILTER (WHERE rn <= 10) || CASE WHEN n > 10 THEN ', ...' ELSE '' END
         AS examples
FROM r GROUP BY col, n""")
def q_warn_unseen(spark, sf):
    """Scoring-time values never seen in training (orders before vs from the cutoff date)."""
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", F.col("o_custkey").cast("string"))
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    cols = ["o_orderpriority", "o_custkey"]
    vocab = category_vocab(o.where(F.col("o_orderdate") < cut), cols)
    return SC.warn_unseen_categories(o.where(F.col("o_orderdate") >= cut), vocab, cols)
