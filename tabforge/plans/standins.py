"""Stand-in inputs built from the test tables.

Each stand-in only reshapes test-table rows into the schema an operator expects
(metadata tables, missing values, typed columns); none of the operator's work
happens here. The text is written in the SQL subset Spark and DuckDB share, so
the DuckDB oracle reads exactly the same input; ``{TS:...}`` marks the one
dialect difference (a timestamp-without-time-zone literal).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

STANDINS: dict[str, str] = {
    # ---- run-history metadata (projects / datasets / jobs / models / predictions / audit)
    "s_projects": """
        SELECT c_custkey AS project_id, c_name AS project_name, c_mktsegment AS description,
               CAST(c_nationkey AS BIGINT) AS owner_user_id,
               {TS:2020-01-01 00:00:00} + c_custkey * INTERVAL 1 HOUR AS created_at
        FROM customer""",
    "s_datasets": """
        SELECT p_partkey AS dataset_id, CAST(p_size * 30 AS BIGINT) AS project_id,
               p_name || '.csv' AS file_name, CAST(p_size * 1000 AS BIGINT) AS row_count
        FROM part""",
    "s_jobs": """
        SELECT o_orderkey AS training_job_id, o_custkey AS project_id, o_custkey AS dataset_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'classification'
                    ELSE 'regression' END AS task_type,
               'target' AS target_column,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'f1' ELSE 'rmse' END AS metric_key,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               o_orderdate AS created_at,
               o_orderdate AS started_at,
               CASE WHEN o_orderstatus = 'O' THEN NULL
                    ELSE o_orderdate + (CAST(floor(o_totalprice) AS BIGINT) % 1000 - 100) * INTERVAL 1 SECOND END AS ended_at
        FROM orders""",
    "s_models": """
        SELECT l_orderkey AS training_job_id, l_linenumber AS model_line, l_extendedprice AS model_price,
               'algo_' || l_returnflag || l_linestatus AS algorithm_name,
               CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN NULL ELSE l_extendedprice END AS metric_score,
               l_shipdate AS created_at
        FROM lineitem""",
    # prediction chain: lineitem (prediction) → orders (model) → customer (job) → nation (project)
    "s_predictions": """
        SELECT l_orderkey AS model_id, l_linenumber AS line, l_extendedprice AS price,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'running' END AS status,
               CASE l_linestatus WHEN 'O' THEN 'form' ELSE 'file' END AS input_type,
               l_shipdate AS created_at
        FROM lineitem""",
    "s_pmodels": """
        SELECT o_orderkey AS model_id, o_orderpriority AS algorithm_name, o_custkey AS training_job_id FROM orders""",
    "s_pjobs": """SELECT c_custkey AS training_job_id, CAST(c_nationkey AS BIGINT) AS project_id FROM customer""",
    "s_pprojects": """SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS project_name FROM nation""",
    "s_audit": """
        SELECT event_id AS audit_log_id, user_id,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'training.failed'
                    WHEN event_type = 'error' THEN 'prediction_failed'
                    WHEN event_type = 'signup' THEN 'project.created'
                    WHEN event_type = 'view' AND value < 5 THEN 'failed'
                    ELSE event_type || '.done' END AS action_type,
               CASE WHEN event_type = 'signup' THEN 'Project' WHEN event_type = 'error' THEN 'TrainingJob'
                    ELSE 'Model' END AS target_type,
               user_id AS target_id, ts AS action_time, props AS detail_json
        FROM events""",
    "s_status_events": """
        SELECT event_id, user_id AS job_id, ts,
               CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
                    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
               event_type || ': ' || props AS line
        FROM events""",
    # ---- text columns for the datetime detector (95 % / 90 % parseable, numeric text, mixed)
    "s_texty": """
        SELECT event_id, ts,
               {FMT_TS:ts} AS ts_text,
               CASE WHEN event_id % 20 = 0 THEN 'not-a-date' ELSE {FMT_TS:ts} END AS ts_text_95,
               CASE WHEN event_id % 10 = 0 THEN 'not-a-date' ELSE {FMT_TS:ts} END AS ts_text_90,
               substr({FMT_TS:ts}, 1, 10) AS day_text,
               CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) AS value_text,
               CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS STRING) ELSE substr({FMT_TS:ts}, 1, 10) END AS mixed_text,
               event_type, props
        FROM events""",
    # ---- boolean-looking columns for the bool detector
    "s_boolish": """
        SELECT event_id,
               value > 45 AS is_big,
               CASE WHEN value > 45 THEN 1 ELSE 0 END AS bit,
               CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 45 THEN 1 ELSE 0 END AS bit_missing,
               user_id % 2 AS parity,
               CASE WHEN value > 45 THEN ' Yes' ELSE 'no ' END AS yes_no,
               CASE WHEN value > 45 THEN 'Y' WHEN event_type = 'error' THEN 'maybe' ELSE 'N' END AS y_maybe,
               CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 45 THEN 'TRUE' ELSE 'false' END AS tf_null,
               value, event_type
        FROM events""",
    # ---- a class with a single row (stratification impossible)
    "s_cust_cls": """
        SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'SINGLETON' ELSE c_mktsegment END AS segment FROM customer""",
    # ---- rule-based predictions (metric inputs)
    "s_cls": """
        SELECT event_id, CASE WHEN value > 45 THEN 1 ELSE 0 END AS y,
               CASE WHEN value > 60 OR user_id % 4 = 0 THEN 1 ELSE 0 END AS p,
               CASE WHEN value > 45 THEN 1 ELSE 0 END AS p_exact,
               CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS p_parity,
               CAST(floor(value / 10) AS DOUBLE) / 50 + CASE WHEN user_id % 4 = 0 THEN 0.3 ELSE 0 END AS score
        FROM events""",
    "s_mc": """
        SELECT vec_id, label AS y,
               CASE WHEN {EL:embedding,1} > {EL:embedding,2} THEN label ELSE (label + 1) % 10 END AS p,
               """ + ", ".join(f"CAST({{EL:embedding,{i + 1}}} AS DOUBLE) AS s{i}" for i in range(10)) + """
        FROM embeddings""",
    "s_reg": """
        SELECT l_orderkey, l_extendedprice AS y, l_quantity * 1500 + l_discount * 1000 AS p
        FROM lineitem""",
    # ---- events with missing values injected (preprocessing input)
    "s_ev": """
        SELECT event_id, ts, CAST(user_id AS DOUBLE) AS user_num,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(value * value AS DOUBLE) END AS value_sq,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts_m,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 100 END AS is_big,
               CASE WHEN value > 45 THEN 1 ELSE 0 END AS target
        FROM events""",
    # ---- scoring input: numbers as text with junk tokens, plus an extra column
    "s_score_in": """
        SELECT CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 10 = 0 THEN ' 12.5 '
                    ELSE CAST(value AS STRING) END AS value,
               CAST(user_id AS DOUBLE) AS user_num, event_type, props AS extra
        FROM events""",
}


def _dialect(sql: str, engine: str) -> str:
    def ts(m: re.Match) -> str:
        return f"TIMESTAMP_NTZ '{m.group(1)}'" if engine == "spark" else f"TIMESTAMP '{m.group(1)}'"

    def fmt(m: re.Match) -> str:
        c = m.group(1)
        return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')" if engine == "spark" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

    def el(m: re.Match) -> str:
        arr, idx = m.group(1), m.group(2)
        return f"element_at({arr}, {idx})" if engine == "spark" else f"{arr}[{idx}]"

    sql = re.sub(r"\{FMT_TS:([^}]*)\}", fmt, sql)
    sql = re.sub(r"\{EL:([^,}]*),([^}]*)\}", el, sql)
    return re.sub(r"\{TS:([^}]*)\}", ts, sql)


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a stand-in (base tables registered as views first)."""
    sql = STANDINS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    register_tables(spark, sf_dir, used)
    return spark.sql(_dialect(sql, "spark"))


def with_standins(names: list[str], body: str) -> str:
    """DuckDB oracle text: stand-ins as CTEs followed by ``body``."""
    ctes = ",\n".join(f"{n} AS ({_dialect(STANDINS[n], 'duckdb').strip()})" for n in names)
    return f"WITH {ctes}\n{body}"
