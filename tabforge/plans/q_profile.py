"""Profiling and type-inference queries (§2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.columns import NUMBER_PATTERN
from tabforge.operators import profile as P
from tabforge.plans.registry import register
from tabforge.plans.standins import standin, table, with_standins

# Spark type names of the test tables used below.
LINEITEM_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
CUSTOMER_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                  ("c_mktsegment", "string")]


def _profile_sql(tbl: str, types) -> str:
    parts = []
    for i, (c, t) in enumerate(types):
        miss = f"count(*) - count({c})" if t != "double" else f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))"
        parts.append(
            f"SELECT {i} AS column_idx, '{c}' AS name, '{t}' AS dtype, CAST({miss} AS BIGINT) AS n_missing, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, count(*) AS n_rows FROM {tbl}")
    return ("SELECT column_idx, name, dtype, n_missing, n_unique, n_rows, "
            "round(n_missing / greatest(n_rows, 1), 6) AS missing_ratio, "
            "round(n_unique / greatest(n_rows, 1), 6) AS unique_ratio FROM (" + " UNION ALL ".join(parts) + ")")


@register("profile", sql=_profile_sql("lineitem", LINEITEM_TYPES))
def q_profile(spark, sf):
    """One-pass profile of every lineitem column (missing / distinct counts and ratios)."""
    return P.profile(table(spark, sf, "lineitem"))


@register("suggest_excluded", sql="SELECT column_idx, name, unique_ratio FROM (" + _profile_sql(
    "customer", CUSTOMER_TYPES) + ") WHERE n_rows >= 2 AND unique_ratio >= 0.95")
def q_suggest_excluded(spark, sf):
    """Identifier-suspect customer columns (unique ratio ≥ 0.95)."""
    return P.suggest_excluded(P.profile(table(spark, sf, "customer")))


_TEXT_COLS = ["ts_text", "ts_text_95", "ts_text_90", "day_text", "value_text", "mixed_text", "event_type", "props"]


def _detect_dt_sql() -> str:
    layouts = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y")
    dt = "coalesce(" + ", ".join(f"try_strptime(trim({{c}}), '{d}')" for d in layouts) + ")"
    num = "CASE WHEN regexp_matches(trim({c}), '" + NUMBER_PATTERN + "') THEN 1 END"
    cols = ["event_id", "ts"] + _TEXT_COLS
    parts = ["SELECT 1 AS column_idx, 'ts' AS name, CAST(NULL AS DOUBLE) AS numeric_ratio, "
             "CAST(NULL AS DOUBLE) AS datetime_ratio, true AS is_datetime"]
    for c in _TEXT_COLS:
        i = cols.index(c)
        nn = f"count({c})"
        nr = f"CASE WHEN {nn} > 0 THEN count({num.format(c=c)}) / {nn} END"
        dr = f"CASE WHEN {nn} > 0 THEN count({dt.format(c=c)}) / {nn} END"
        parts.append(f"SELECT {i} AS column_idx, '{c}' AS name, round({nr}, 6) AS numeric_ratio, "
                     f"round({dr}, 6) AS datetime_ratio, "
                     f"coalesce(count(*) > 0 AND {nn} > 0 AND {nr} < 0.8 AND {dr} >= 0.95, false) AS is_datetime "
                     f"FROM s_texty")
    return with_standins(["s_texty"], " UNION ALL ".join(parts))


@register("detect_datetime", sql=_detect_dt_sql())
def q_detect_datetime(spark, sf):
    """Datetime candidates: typed columns plus text that parses (≥95 %) and is not numeric (<80 %)."""
    return P.detect_datetime(standin(spark, sf, "s_texty"))


_BOOL_COLS = ["event_id", "is_big", "bit", "bit_missing", "parity", "yes_no", "y_maybe", "tf_null", "value",
              "event_type"]


def _detect_bool_sql() -> str:
    toks = ", ".join(f"'{t}'" for t in P.BOOL_TOKENS)
    rules = {
        "event_id": "count(event_id) > 0 AND count(*) FILTER (WHERE event_id IS NULL) = 0 AND bool_and(event_id IN (0, 1))",
        "is_big": "count(*) >= 0",
        "bit": "count(bit) > 0 AND count(*) FILTER (WHERE bit IS NULL) = 0 AND bool_and(bit IN (0, 1))",
        "bit_missing": "count(bit_missing) > 0 AND count(*) FILTER (WHERE bit_missing IS NULL) = 0 "
                       "AND bool_and(bit_missing IN (0, 1))",
        "parity": "count(parity) > 0 AND count(*) FILTER (WHERE parity IS NULL) = 0 AND bool_and(parity IN (0, 1))",
        "value": "count(*) < 0",
    }
    parts = []
    for i, c in enumerate(_BOOL_COLS):
        r = rules.get(c, f"count({c}) > 0 AND bool_and(lower(trim({c})) IN ({toks}))")
        parts.append(f"SELECT {i} AS column_idx, '{c}' AS name, coalesce({r}, false) AS is_bool FROM s_boolish")
    return with_standins(["s_boolish"], " UNION ALL ".join(parts))


@register("detect_bool", sql=_detect_bool_sql())
def q_detect_bool(spark, sf):
    """Boolean candidates: bool type, complete 0/1 integers, or yes/no-style tokens."""
    return P.detect_bool(standin(spark, sf, "s_boolish"))


_HC_REQ = ["p_brand", "p_name", "not_a_column", "p_type", "p_size"]


@register("detect_highcard", sql="""
SELECT request_idx, name, n_unique, n_unique > 50 OR (n_rows >= 2 AND n_unique / n_rows > 0.3) AS is_highcard FROM (
  SELECT 0 AS request_idx, 'p_brand' AS name, count(DISTINCT p_brand) AS n_unique, count(*) AS n_rows FROM part
  UNION ALL SELECT 1, 'p_name', count(DISTINCT p_name), count(*) FROM part
  UNION ALL SELECT 3, 'p_type', count(DISTINCT p_type), count(*) FROM part
  UNION ALL SELECT 4, 'p_size', count(DISTINCT p_size), count(*) FROM part)""")
def q_detect_highcard(spark, sf):
    """High-cardinality part columns (>50 distinct or ratio >0.3); unknown names skipped."""
    part = table(spark, sf, "part")
    return P.detect_highcard(P.profile(part), _HC_REQ)


_SKEW_REQ = ["value", "event_id", "user_num", "value_sq", "flat", "event_type"]


@register("skew_report", sql=with_standins(["s_ev"], """
SELECT request_idx, name, round(skew, 6) AS skew FROM (
  SELECT 0 AS request_idx, 'value' AS name, skewness(value) AS skew FROM s_ev
  UNION ALL SELECT 1, 'event_id', skewness(event_id) FROM s_ev
  UNION ALL SELECT 2, 'user_num', skewness(user_num) FROM s_ev
  UNION ALL SELECT 3, 'value_sq', skewness(value_sq) FROM s_ev)
WHERE skew IS NOT NULL AND NOT isnan(skew) AND abs(skew) >= 1.0"""))
def q_skew_report(spark, sf):
    """Adjusted sample skewness of numeric columns, kept when |skew| ≥ 1."""
    ev = standin(spark, sf, "s_ev").withColumn("flat", F.lit(1.0))
    return P.skew_report(ev, _SKEW_REQ)


@register("category_vocab", sql="""
SELECT 'p_brand' AS "column", p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS idx
FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL
SELECT 'p_type', p_type, row_number() OVER (ORDER BY p_type) - 1 FROM (SELECT DISTINCT p_type FROM part)
UNION ALL
SELECT 'p_name', p_name, row_number() OVER (ORDER BY p_name) - 1 FROM (SELECT DISTINCT p_name FROM part)""")
def q_category_vocab(spark, sf):
    """Sorted vocabulary (with index) of the categorical part columns."""
    return P.category_vocab(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])
