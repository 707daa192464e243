"""Imputation, clipping, scaling, encoding and feature queries (§2.2, §2.4–2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.columns import clip_nullsafe, q, to_double
from tabforge.operators import preprocess as PP
from tabforge.operators.split import split_random
from tabforge.plans.config import FeatureSchema, PreprocessingConfig
from tabforge.plans.registry import register
from tabforge.plans.standins import standin, table, with_standins

EV_NUM = ["user_num", "value", "value_sq"]
HASH = "CAST('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8) AS BIGINT)"


def _r(c):
    return F.round(c, 6)


def _ev(spark, sf):
    return standin(spark, sf, "s_ev")


# ------------------------------------------------------------------ imputation


def _impute_query(strategy: str):
    def run(spark, sf):
        ev = _ev(spark, sf)
        fills = PP.fit_numeric_impute(ev, ["value", "value_sq"], strategy)
        return ev.select("event_id", *[_r(F.coalesce(to_double(q(c)), F.lit(fills[c]))).alias(c)
                                       for c in ("value", "value_sq")])
    return run


def _impute_sql(stat: str) -> str:
    return with_standins(["s_ev"], f"""
SELECT event_id, round(coalesce(value, (SELECT {stat.format(c='value')} FROM s_ev)), 6) AS value,
       round(coalesce(value_sq, (SELECT {stat.format(c='value_sq')} FROM s_ev)), 6) AS value_sq FROM s_ev""")


MODE_SQL = "(SELECT {c} FROM s_ev WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
register("impute_median", sql=_impute_sql("median({c})"), doc="Numeric median imputation (exact distributed median).")(_impute_query("median"))
register("impute_mean", sql=_impute_sql("avg({c})"), doc="Numeric mean imputation.")(_impute_query("mean"))
register("impute_zero", sql=_impute_sql("min(0.0)"), doc="Numeric constant-zero imputation.")(_impute_query("constant_zero"))
register("impute_most_frequent", sql=with_standins(["s_ev"], f"""
SELECT event_id, round(coalesce(value, {MODE_SQL.format(c='value')}), 6) AS value,
       round(coalesce(value_sq, {MODE_SQL.format(c='value_sq')}), 6) AS value_sq FROM s_ev"""),
         doc="Numeric mode imputation (ties → smallest value).")(_impute_query("most_frequent"))


@register("impute_cat_most_frequent", sql=with_standins(["s_ev"], f"""
SELECT event_id, coalesce(event_type, {MODE_SQL.format(c='event_type')}) AS event_type FROM s_ev"""))
def q_impute_cat_mode(spark, sf):
    """Categorical mode imputation (ties → smallest value)."""
    ev = _ev(spark, sf)
    fill = PP.fit_categorical_impute(ev, ["event_type"], "most_frequent")["event_type"]
    return ev.select("event_id", F.coalesce(F.col("event_type"), F.lit(fill)).alias("event_type"))


@register("impute_cat_constant", sql=with_standins(["s_ev"], """
SELECT event_id, coalesce(event_type, '__MISSING__') AS event_type FROM s_ev"""))
def q_impute_cat_constant(spark, sf):
    """Categorical constant imputation with '__MISSING__'."""
    ev = _ev(spark, sf)
    fill = PP.fit_categorical_impute(ev, ["event_type"], "constant_missing")["event_type"]
    return ev.select("event_id", F.coalesce(F.col("event_type"), F.lit(fill)).alias("event_type"))


DT_PARTS_SQL = {
    "year": "CAST(year({c}) AS DOUBLE)",
    "month": "CAST(month({c}) AS DOUBLE)",
    "day": "CAST(day({c}) AS DOUBLE)",
    "weekday": "CAST(isodow({c}) - 1 AS DOUBLE)",
    "hour": "CAST(hour({c}) AS DOUBLE)",
    "is_weekend": "CAST(coalesce(isodow({c}) - 1 IN (5, 6), false) AS DOUBLE)",
}
ALL_PARTS = ("year", "month", "day", "weekday", "hour", "is_weekend")


@register("impute_datetime_parts", sql=with_standins(["s_ev"], "SELECT event_id, " + ", ".join(
    f"round(coalesce({DT_PARTS_SQL[p].format(c='ts_m')}, (SELECT median({DT_PARTS_SQL[p].format(c='ts_m')}) "
    f"FROM s_ev)), 6) AS ts_m_{p}" for p in ALL_PARTS) + " FROM s_ev"))
def q_impute_datetime_parts(spark, sf):
    """Datetime decomposition with each part's missing values filled by its median."""
    ev = _ev(spark, sf)
    cfg = PreprocessingConfig(datetime_decompose=True, datetime_parts=ALL_PARTS)
    model = PP.Preprocessor(cfg, [], [], ["ts_m"], []).fit(ev)
    out = model.transform(ev, keep=["event_id"])
    return out.select("event_id", *[_r(F.col(f"ts_m_{p}")).alias(f"ts_m_{p}") for p in ALL_PARTS])


# ------------------------------------------------------------------ clip / scale


def _clip_query(method: str):
    def run(spark, sf):
        ev = _ev(spark, sf)
        bounds = PP.fit_clip_bounds(ev, {"value": to_double(F.col("value"))}, method, 1.5, 0.01)["value"]
        return ev.select("event_id", _r(clip_nullsafe(to_double(F.col("value")), *bounds)).alias("value"))
    return run


register("iqr_clip", sql=with_standins(["s_ev"], """,
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s_ev)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL
                       ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS value
FROM s_ev, b"""), doc="Clip to [Q1 − 1.5·IQR, Q3 + 1.5·IQR]; missing passes through.")(_clip_query("iqr_clip"))
register("winsorize", sql=with_standins(["s_ev"], """,
b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM s_ev)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, lo), hi) END, 6) AS value
FROM s_ev, b"""), doc="Winsorize to the 1 % / 99 % quantiles.")(_clip_query("winsorize"))


def _scale_query(method: str):
    def run(spark, sf):
        ev = _ev(spark, sf)
        exprs = {c: to_double(q(c)) for c in ("value", "value_sq")}
        st = PP.fit_scaler(ev, exprs, method)
        return ev.select("event_id", *[_r((exprs[c] - F.lit(st[c][0])) / F.lit(st[c][1])).alias(c) for c in exprs])
    return run


def _scale_sql(center: str, div: str) -> str:
    cols = ["value", "value_sq"]
    stats = ", ".join(f"{center.format(c=c)} AS {c}_c, {div.format(c=c)} AS {c}_d" for c in cols)
    sel = ", ".join(f"round(({c} - {c}_c) / CASE WHEN {c}_d = 0 THEN 1 ELSE {c}_d END, 6) AS {c}" for c in cols)
    return with_standins(["s_ev"], f""",
st AS (SELECT {stats} FROM s_ev)
SELECT event_id, {sel} FROM s_ev, st""")


register("scale_standard", sql=_scale_sql("avg({c})", "stddev_pop({c})"),
         doc="(x − mean) / population std (0 → 1).")(_scale_query("standard"))
register("scale_minmax", sql=_scale_sql("min({c})", "max({c}) - min({c})"), doc="(x − min) / (max − min) (0 → 1).")(_scale_query("minmax"))
register("scale_robust", sql=_scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
         doc="(x − median) / IQR (0 → 1).")(
    _scale_query("robust"))


# ------------------------------------------------------------------ encoding

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")  # vocabulary of the events stand-in (oracle side)


@register("encode_onehot", sql=with_standins(["s_ev"], f""",
m AS ({MODE_SQL.format(c='event_type')})
SELECT event_id, """ + ", ".join(
    f"CASE WHEN coalesce(event_type, (SELECT * FROM m)) = '{v}' THEN 1.0 ELSE 0.0 END AS event_type__{v}"
    for v in EVENT_TYPES) + " FROM s_ev"))
def q_encode_onehot(spark, sf):
    """Mode-impute then one-hot encode event_type (sorted vocabulary; unseen → zeros)."""
    ev = _ev(spark, sf)
    cfg = PreprocessingConfig(categorical_encoding="onehot")
    return PP.Preprocessor(cfg, [], ["event_type"]).fit(ev).transform(ev, keep=["event_id"])


@register("encode_ordinal", sql="""
WITH seg AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
             FROM (SELECT DISTINCT c_mktsegment FROM customer)),
nm AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, CAST(seg.code AS DOUBLE) AS c_mktsegment, CAST(nm.code AS DOUBLE) AS c_name
FROM customer JOIN seg ON seg.v = c_mktsegment JOIN nm ON nm.v = c_name""")
def q_encode_ordinal(spark, sf):
    """Ordinal codes (rank in sorted vocabulary); small vocabularies inline, large ones joined."""
    cu = table(spark, sf, "customer")
    cfg = PreprocessingConfig(categorical_encoding="ordinal")
    return PP.Preprocessor(cfg, [], ["c_mktsegment", "c_name"]).fit(cu).transform(cu, keep=["c_custkey"])


@register("encode_frequency", sql="""
WITH n AS (SELECT count(*) AS n FROM orders),
pr AS (SELECT o_orderpriority AS v, count(*) / (SELECT n FROM n) AS f FROM orders GROUP BY 1),
cu AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) / (SELECT n FROM n) AS f FROM orders GROUP BY 1)
SELECT o_orderkey, round(pr.f, 9) AS o_orderpriority, round(cu.f, 9) AS o_custkey
FROM orders JOIN pr ON pr.v = o_orderpriority JOIN cu ON cu.v = CAST(o_custkey AS VARCHAR)""")
def q_encode_frequency(spark, sf):
    """Frequency encoding (share of non-missing training rows; unseen → 0)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string"))
    cfg = PreprocessingConfig(categorical_encoding="frequency")
    out = PP.Preprocessor(cfg, [], ["o_orderpriority", "o_custkey"]).fit(o).transform(o, keep=["o_orderkey"])
    return out.select("o_orderkey", *[F.round(c, 9).alias(c) for c in ("o_orderpriority", "o_custkey")])


@register("encoding_routing", sql="""
SELECT name, n_unique, CASE WHEN n_unique > 50 THEN 'frequency' ELSE 'onehot' END AS encoding,
       n_unique > 50 AS downgraded FROM (
  SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS n_unique FROM part
  UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)""")
def q_encoding_routing(spark, sf):
    """One-hot requested; columns above 50 distinct values are downgraded to frequency."""
    part = table(spark, sf, "part")
    cols = ["p_brand", "p_name", "p_type"]
    enc, down, counts = PP.encoding_routing(part, cols, PreprocessingConfig())
    rows = [(c, counts[c], enc[c], c in down) for c in cols]
    return spark.createDataFrame(rows, "name string, n_unique long, encoding string, downgraded boolean")


_DF_CFG = PreprocessingConfig(datetime_decompose=True, datetime_parts=("year", "weekday"))


@register("derived_features", sql=with_standins(["s_ev"], """
SELECT name, source, kind, row_number() OVER (ORDER BY grp, sub) - 1 AS feature_idx FROM (
  SELECT 0 AS grp, row_number() OVER (ORDER BY event_type) AS sub, 'event_type__' || event_type AS name,
         'event_type' AS source, 'onehot' AS kind FROM (SELECT DISTINCT event_type FROM s_ev WHERE event_type IS NOT NULL)
  UNION ALL SELECT 1, 0, 'ts_m_year', 'ts_m', 'datetime_year'
  UNION ALL SELECT 1, 1, 'ts_m_weekday', 'ts_m', 'datetime_weekday'
  UNION ALL SELECT 2, 0, 'is_big', 'is_big', 'bool_numeric')"""))
def q_derived_features(spark, sf):
    """Derived feature list without fitting (one-hot values from the full data)."""
    ev = _ev(spark, sf)
    num, cat, dt, bl = PP.columns_by_role(ev, "target", ["event_id", "ts"])
    return PP.derived_features(ev, cat, dt, bl, _DF_CFG, {c: "onehot" for c in cat})


@register("feature_preview", sql="""
SELECT 4 AS n_cols_in, 1 + count(DISTINCT p_brand) + count(DISTINCT p_type) + 1 AS n_cols_out,
       count(DISTINCT p_brand) + count(DISTINCT p_type) + 1 AS n_derived,
       CASE WHEN count(DISTINCT p_name) > 50 THEN 'p_name' ELSE '' END AS downgraded FROM part""")
def q_feature_preview(spark, sf):
    """No-fit preprocessing summary: input/output column counts and downgrades."""
    part = table(spark, sf, "part")
    num, cat, dt, bl = PP.columns_by_role(part, "p_retailprice", ["p_partkey"])
    return PP.feature_preview(part, num, cat, dt, bl, PreprocessingConfig())


@register("feature_schema", sql=with_standins(["s_ev"], """
SELECT * FROM (VALUES ('target', 'target', NULL, 0), ('numeric', 'user_num', NULL, 0), ('numeric', 'value', NULL, 1),
  ('numeric', 'value_sq', NULL, 2), ('categorical', 'event_type', NULL, 0), ('datetime', 'ts_m', NULL, 0),
  ('boolean', 'is_big', NULL, 0)) AS t(role, "column", value, idx)
UNION ALL
SELECT 'derived', name, kind, row_number() OVER (ORDER BY grp, sub) - 1 FROM (
  SELECT 0 AS grp, row_number() OVER (ORDER BY event_type) AS sub, 'event_type__' || event_type AS name,
         'onehot' AS kind FROM (SELECT DISTINCT event_type FROM s_ev WHERE event_type IS NOT NULL)
  UNION ALL SELECT 1, 0, 'ts_m_year', 'datetime_year' UNION ALL SELECT 1, 1, 'ts_m_weekday', 'datetime_weekday'
  UNION ALL SELECT 2, 0, 'is_big', 'bool_numeric')
UNION ALL
SELECT 'category', 'event_type', event_type, row_number() OVER (ORDER BY event_type) - 1
FROM (SELECT DISTINCT event_type FROM s_ev WHERE event_type IS NOT NULL)"""))
def q_feature_schema(spark, sf):
    """Feature schema (roles, derived features, categories) as rows."""
    ev = _ev(spark, sf)
    num, cat, dt, bl = PP.columns_by_role(ev, "target", ["event_id", "ts"])
    schema = PP.build_feature_schema(ev, num, cat, dt, bl, "target", _DF_CFG)
    return PP.feature_schema_rows(ev, schema)


# ------------------------------------------------------------------ features


@register("datetime_parts", sql=with_standins(["s_ev", "s_texty"], """,
dt AS (SELECT event_id, """ + ", ".join(f"{DT_PARTS_SQL[p].format(c='ts_m')} AS ts_m_{p}" for p in ALL_PARTS) + """
       FROM s_ev),
tx AS (SELECT event_id, coalesce(""" + ", ".join(
    f"try_strptime(trim(ts_text_95), '{d}')" for d in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M",
                                                         "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y")) + """) AS p FROM s_texty)
SELECT dt.*, """ + ", ".join(f"{DT_PARTS_SQL[p].format(c='tx.p')} AS ts_text_95_{p}" for p in ALL_PARTS) + """
FROM dt JOIN tx ON tx.event_id = dt.event_id"""))
def q_datetime_parts(spark, sf):
    """Six datetime parts from a timestamp column and from a text column (unparseable → missing)."""
    ev = _ev(spark, sf).select("event_id", "ts_m")
    tx = standin(spark, sf, "s_texty").select("event_id", "ts_text_95")
    j = ev.join(tx, on="event_id")
    return j.select("event_id", *PP.datetime_parts(j, ["ts_m", "ts_text_95"], ALL_PARTS))


_BOOLISH = ["is_big", "bit", "parity", "yes_no", "y_maybe", "tf_null", "value", "event_type"]


@register("bool_to_numeric", sql=with_standins(["s_boolish"], """
SELECT event_id, CAST(is_big AS DOUBLE) AS is_big,
  CASE WHEN bit = 1 THEN 1.0 WHEN bit = 0 THEN 0.0 END AS bit,
  CASE WHEN parity = 1 THEN 1.0 WHEN parity = 0 THEN 0.0 END AS parity,
  """ + ",\n  ".join(
    f"CASE WHEN lower(trim({c})) IN ('1', 't', 'true', 'y', 'yes') THEN 1.0 "
    f"WHEN lower(trim({c})) IN ('0', 'f', 'false', 'n', 'no') THEN 0.0 END AS {c}"
    for c in ("yes_no", "y_maybe", "tf_null", "event_type")) + """,
  CASE WHEN value = 1 THEN 1.0 WHEN value = 0 THEN 0.0 END AS value
FROM s_boolish"""))
def q_bool_to_numeric(spark, sf):
    """Booleans, 0/1 numbers and yes/no-style tokens to 0.0/1.0 (else missing)."""
    b = standin(spark, sf, "s_boolish")
    return b.select("event_id", *[PP.bool_to_numeric(q(c), b.schema[c].dataType).alias(c) for c in _BOOLISH])


@register("bool_passthrough", sql=with_standins(["s_ev"], """,
m AS (SELECT CAST(is_big AS VARCHAR) AS v FROM s_ev WHERE is_big IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
mb AS (SELECT CAST(is_big AS DOUBLE) AS v FROM s_ev WHERE is_big IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(CAST(is_big AS DOUBLE), (SELECT v FROM mb)) AS is_big,
       CASE WHEN coalesce(CAST(is_big AS VARCHAR), (SELECT v FROM m)) = 'false' THEN 1.0 ELSE 0.0 END AS is_big__false,
       CASE WHEN coalesce(CAST(is_big AS VARCHAR), (SELECT v FROM m)) = 'true' THEN 1.0 ELSE 0.0 END AS is_big__true
FROM s_ev"""))
def q_bool_passthrough(spark, sf):
    """Native booleans as 0/1 (missing → training mode) and, switched off, as one-hot categories."""
    ev = _ev(spark, sf)
    a = PP.Preprocessor(PreprocessingConfig(), [], [], [], ["is_big"]).fit(ev).transform(ev, keep=["event_id"])
    b = PP.Preprocessor(PreprocessingConfig(bool_as_numeric=False), [], [], [], ["is_big"]).fit(ev).transform(
        ev, keep=["event_id"])
    return a.join(b.withColumnRenamed("is_big", "is_big_cat"), on="event_id").drop("is_big_cat")


_DM_CFG = PreprocessingConfig(outlier="iqr_clip", datetime_decompose=True,
                              datetime_parts=("hour", "weekday", "is_weekend"))


def _dm_sql() -> str:
    h = HASH.format(k="event_id")
    nums = EV_NUM
    fills = ", ".join(f"median({c}) AS f_{c}" for c in nums)
    imp = ", ".join(f"coalesce({c}, f_{c}) AS i_{c}" for c in nums)
    qs = ", ".join(f"quantile_cont(i_{c}, 0.25) AS q1_{c}, quantile_cont(i_{c}, 0.75) AS q3_{c}" for c in nums)
    clip = "least(greatest(coalesce({c}, f_{c}), q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
    cl = ", ".join(f"{clip.format(c=c)} AS k_{c}" for c in nums)
    sc = ", ".join(f"avg(k_{c}) AS m_{c}, CASE WHEN stddev_pop(k_{c}) = 0 THEN 1 ELSE stddev_pop(k_{c}) END AS s_{c}"
                   for c in nums)
    parts = ("hour", "weekday", "is_weekend")
    dtm = ", ".join(f"median({DT_PARTS_SQL[p].format(c='ts_m')}) AS d_{p}" for p in parts)
    sel = [f"round(({clip.format(c=c)} - m_{c}) / s_{c}, 6) AS {c}" for c in nums]
    sel += [f"CASE WHEN coalesce(event_type, mv) = '{v}' THEN 1.0 ELSE 0.0 END AS event_type__{v}" for v in EVENT_TYPES]
    sel += [f"round(coalesce({DT_PARTS_SQL[p].format(c='ts_m')}, d_{p}), 6) AS ts_m_{p}" for p in parts]
    sel += ["coalesce(CAST(is_big AS DOUBLE), bm) AS is_big"]
    return with_standins(["s_ev"], f""",
sp AS (SELECT *, row_number() OVER (ORDER BY {h}, event_id) <= (SELECT ceil(0.2 * count(*)) FROM s_ev) AS is_test
       FROM s_ev),
tr AS (SELECT * FROM sp WHERE NOT is_test),
f AS (SELECT {fills} FROM tr),
imp AS (SELECT tr.*, {imp} FROM tr, f),
b AS (SELECT {qs} FROM imp),
cl AS (SELECT {cl} FROM tr, f, b),
sc AS (SELECT {sc} FROM cl),
mo AS (SELECT event_type AS mv FROM tr WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
dm AS (SELECT {dtm} FROM tr),
bo AS (SELECT CAST(is_big AS DOUBLE) AS bm FROM tr WHERE is_big IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT sp.event_id, sp.is_test, {', '.join(sel)}
FROM sp, f, b, sc, mo, dm, bo""")


@register("design_matrix", sql=_dm_sql())
def q_design_matrix(spark, sf):
    """Full preprocessing fitted on the training split (median → IQR clip → standard;
    mode → one-hot; datetime parts + median; bool 0/1) applied to every row."""
    ev = _ev(spark, sf)
    sp = split_random(ev, "event_id", 0.2)
    num, cat, dt, bl = PP.columns_by_role(ev, "target", ["event_id", "ts"])
    pre = PP.Preprocessor(_DM_CFG, num, cat, dt, bl).plan_routing(ev)
    model = pre.fit(sp.where(~F.col("is_test")))
    out = model.transform(sp, keep=["event_id", "is_test"])
    rounded = [c for c in model.output_columns if not c.startswith("event_type__") and c != "is_big"]
    return out.select(*[(_r(F.col(c)).alias(c) if c in rounded else F.col(c)) for c in out.columns])


# ------------------------------------------------------------------ projections


@register("prepare_xy", sql=with_standins(["s_ev"], """
SELECT event_id, user_num, event_type, value, value_sq, ts_m, is_big FROM s_ev"""))
def q_prepare_xy(spark, sf):
    """Feature frame: target and the existing excluded columns dropped (unknown names ignored)."""
    return PP.prepare_xy(_ev(spark, sf), "target", ["ts", "no_such_column"])


@register("drop_missing_rows", sql=with_standins(["s_ev"], """
SELECT event_id, value, value_sq FROM s_ev WHERE value IS NOT NULL AND value_sq IS NOT NULL AND user_num IS NOT NULL"""))
def q_drop_missing_rows(spark, sf):
    """drop_rows strategy: rows with any missing numeric feature are removed before the split."""
    ev = _ev(spark, sf)
    return PP.drop_missing_rows(ev, EV_NUM).select("event_id", "value", "value_sq")


_SCORE_SCHEMA = FeatureSchema(numeric=("value", "user_num"), categorical=("event_type",), target="target")


@register("validate_scoring_input", sql=with_standins(["s_score_in"], """
SELECT CASE WHEN regexp_matches(trim(value), '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
            THEN TRY_CAST(trim(value) AS DOUBLE) END AS value,
       user_num, event_type FROM s_score_in"""))
def q_validate_scoring_input(spark, sf):
    """Scoring input projected onto the model's columns: extras dropped, numbers coerced."""
    df, extras = PP.validate_scoring_input(standin(spark, sf, "s_score_in"), _SCORE_SCHEMA)
    return df
