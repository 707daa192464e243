"""Split, class-weight and SMOTE queries (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import balance as B
from tabforge.operators import split as S
from tabforge.plans.registry import register
from tabforge.plans.standins import standin, table, with_standins

H = "CAST('0x' || substr(md5('{salt}:' || CAST({k} AS VARCHAR)), 1, 8) AS BIGINT)"


def _h(k, salt=42):
    return H.format(k=k, salt=salt)


@register("split_random", sql=f"""
SELECT event_id, row_number() OVER (ORDER BY {_h('event_id')}, event_id) <= (SELECT ceil(0.2 * count(*)) FROM events)
  AS is_test FROM events""")
def q_split_random(spark, sf):
    """Reproducible random split: ceil(0.2·n) smallest key hashes are test."""
    return S.split_random(table(spark, sf, "events").select("event_id"), "event_id", 0.2)


def _strat_sql(src: str, key: str, label: str, extra: str = "") -> str:
    return f"""
t AS (SELECT {key} AS k, {label} AS c, {_h(key)} AS h FROM {src}),
cc AS (SELECT c, count(*) AS n_c FROM t GROUP BY c),
tot AS (SELECT sum(n_c) AS n, ceil(0.2 * sum(n_c)) AS n_test FROM cc),
al AS (SELECT c, n_c, floor(n_c * n_test / n) AS base, n_c * n_test / n - floor(n_c * n_test / n) AS rem FROM cc, tot),
al2 AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, c)
                               <= (SELECT n_test FROM tot) - (SELECT sum(base) FROM al) THEN 1 ELSE 0 END AS kk FROM al)
SELECT t.k AS {key}, t.c AS {label}, row_number() OVER (PARTITION BY t.c ORDER BY t.h, t.k) <= al2.kk AS is_test{extra}
FROM t JOIN al2 ON al2.c = t.c"""


@register("split_stratified", sql="WITH " + _strat_sql("orders", "o_orderkey", "o_orderpriority").strip())
def q_split_stratified(spark, sf):
    """Stratified split of orders by priority (largest-remainder allocation)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out, _ = S.split_stratified(o, "o_orderkey", "o_orderpriority", 0.2)
    return out.select("o_orderkey", "o_orderpriority", "is_test")


@register("split_fallback", sql=with_standins(["s_cust_cls"], f"""
SELECT c_custkey, segment,
       row_number() OVER (ORDER BY {_h('c_custkey')}, c_custkey) <= (SELECT ceil(0.2 * count(*)) FROM s_cust_cls)
         AS is_test, 'random' AS method
FROM s_cust_cls"""))
def q_split_fallback(spark, sf):
    """A one-row class makes stratification impossible: falls back to the random split."""
    c = standin(spark, sf, "s_cust_cls")
    out, method = S.split_stratified(c, "c_custkey", "segment", 0.2)
    return out.select("c_custkey", "segment", "is_test", F.lit(method).alias("method"))


@register("class_weight", sql="""
WITH cc AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality)
SELECT l.doc_id, l.quality, round((SELECT sum(n_c) FROM cc) / ((SELECT count(*) FROM cc) * cc.n_c), 9) AS weight
FROM labels l JOIN cc ON cc.quality = l.quality""")
def q_class_weight(spark, sf):
    """Balanced class weights n / (k·n_c) attached to each labelled document."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return S.with_class_weight(lab, "quality").select("doc_id", "quality", F.round("weight", 9).alias("weight"))


_SMOTE_SQL = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cc AS (SELECT label, count(*) AS n FROM e GROUP BY label),
mx AS (SELECT max(n) AS m FROM cc),
pos AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM e),
nn AS (SELECT a.vec_id AS q, b.vec_id AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v),
              b.vec_id) AS rk
       FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rk <= 5),
gen AS (SELECT label, n, unnest(range(1, m - n + 1)) AS j FROM cc, mx WHERE n < m),
g2 AS (SELECT label, j, n, CAST(label AS VARCHAR) || ':' || CAST(j AS VARCHAR) AS key FROM gen),
g3 AS (SELECT label, j, {_h('key', 43).replace("CAST(key AS VARCHAR)", "key")} % n AS pos,
              1 + {_h('key', 44).replace("CAST(key AS VARCHAR)", "key")} % 5 AS rk,
              {_h('key', 45).replace("CAST(key AS VARCHAR)", "key")} / 4294967296.0 AS u FROM g2),
s AS (SELECT g3.label, g3.j, pos.vec_id AS base_id, nn.t AS nb_id, g3.u, x.v AS xv, y.v AS yv
      FROM g3 JOIN pos ON pos.label = g3.label AND pos.pos = g3.pos
      JOIN nn ON nn.q = pos.vec_id AND nn.rk = g3.rk
      JOIN e x ON x.vec_id = pos.vec_id JOIN e y ON y.vec_id = nn.t)
SELECT label, j, base_id, nb_id, round(u, 9) AS u,
       round(xv[1] + u * (yv[1] - xv[1]), 9) AS x0,
       round(list_sum(list_transform(range(1, len(xv) + 1), lambda i: xv[i] + u * (yv[i] - xv[i]))), 6) AS xsum
FROM s"""


@register("smote", sql=_SMOTE_SQL)
def q_smote(spark, sf):
    """SMOTE: every minority class of the embeddings raised to the majority size
    with hash-chosen base rows, same-class neighbours (exact kNN) and gaps."""
    e = table(spark, sf, "embeddings")
    syn = B.smote(e, id_col="vec_id", label_col="label", vec_col="embedding", k=5)
    return syn.select("label", "j", "base_id", "nb_id", F.round("u", 9).alias("u"),
                      F.round(F.col("embedding")[0], 9).alias("x0"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("xsum"))
