"""Run-history queries (§2.12 and the history-side filters of §2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import history as H
from tabforge.plans.registry import register
from tabforge.plans.standins import standin, table, with_standins

# Fixed query parameters used by the registered history queries.
PROJECT_ID = 7
SINCE = "1996-01-01 00:00:00"
UNTIL = "1999-01-01 00:00:00"


def _models(spark, sf):
    return H.mark_best(standin(spark, sf, "s_models"), order_cols=("model_line", "model_price"))


def _models_sql_cte() -> str:
    return """s_mb AS (SELECT *, metric_score IS NOT NULL AND row_number() OVER (
                PARTITION BY training_job_id ORDER BY metric_score DESC NULLS LAST, model_line, model_price) = 1
              AS is_best FROM s_models)"""


@register("history_filter", sql=with_standins(["s_jobs"], f"""
SELECT training_job_id, project_id, status, created_at FROM s_jobs
WHERE status = 'completed' AND created_at >= TIMESTAMP '{SINCE}' AND created_at < TIMESTAMP '{UNTIL}'"""))
def q_history_filter(spark, sf):
    """Training jobs filtered by status and a half-open creation window."""
    j = standin(spark, sf, "s_jobs")
    return H.history_filter(j, status="completed", since=SINCE, until=UNTIL).select(
        "training_job_id", "project_id", "status", "created_at")


@register("like_failed", sql=with_standins(["s_audit"], """
SELECT audit_log_id, action_type FROM s_audit WHERE action_type LIKE '%_failed'"""))
def q_like_failed(spark, sf):
    """Audit rows whose action matches LIKE '%_failed' ('_' is a wildcard)."""
    a = standin(spark, sf, "s_audit")
    return a.where(H.like_failed(F.col("action_type"))).select("audit_log_id", "action_type")


@register("predictable_models", sql=with_standins(["s_models"], "," + _models_sql_cte() + """
SELECT training_job_id, model_line, model_price, algorithm_name, metric_score, is_best
FROM s_mb WHERE metric_score IS NOT NULL"""))
def q_predictable_models(spark, sf):
    """Models that can score (non-null metric), with the derived best flag."""
    m = _models(spark, sf)
    return m.where(F.col("metric_score").isNotNull()).select(
        "training_job_id", "model_line", "model_price", "algorithm_name", "metric_score", "is_best")


@register("period_filter", sql=with_standins(["s_jobs"], """
SELECT training_job_id, created_at FROM s_jobs
WHERE created_at >= (SELECT max(created_at) FROM s_jobs) - INTERVAL 30 DAY"""))
def q_period_filter(spark, sf):
    """Jobs of the last 30 days relative to the newest job (explicit as-of instant)."""
    j = standin(spark, sf, "s_jobs")
    newest = j.agg(F.max("created_at")).scalar()
    return H.period_filter(j, "created_at", "30d", newest).select("training_job_id", "created_at")


@register("admin_stats", sql=with_standins(["s_projects", "s_datasets", "s_jobs", "s_models", "s_predictions"], """
SELECT (SELECT count(*) FROM s_projects) AS projects,
       (SELECT count(*) FROM s_datasets) AS datasets,
       (SELECT count(*) FROM s_jobs) AS training_jobs,
       (SELECT count(*) FILTER (WHERE status = 'failed') FROM s_jobs) AS training_failures,
       (SELECT count(*) FROM s_models) AS models,
       (SELECT count(*) FROM s_predictions) AS predictions,
       (SELECT count(*) FILTER (WHERE status = 'failed') FROM s_predictions) AS prediction_failures"""))
def q_admin_stats(spark, sf):
    """Entity counts and failed-status counts."""
    return H.admin_stats(standin(spark, sf, "s_projects"), standin(spark, sf, "s_datasets"),
                         standin(spark, sf, "s_jobs"), standin(spark, sf, "s_models"),
                         standin(spark, sf, "s_predictions"))


_TH_SQL = with_standins(["s_jobs", "s_projects", "s_models"], "," + _models_sql_cte() + """,
agg AS (SELECT training_job_id, count(*) AS n_total, count(*) FILTER (WHERE metric_score IS NULL) AS n_failed
        FROM s_models GROUP BY training_job_id),
best AS (SELECT training_job_id, algorithm_name AS best_algo, metric_score AS best_metric FROM s_mb WHERE is_best)
SELECT j.training_job_id, j.project_id, p.project_name, j.dataset_id, j.task_type, j.target_column, j.metric_key,
       j.status, j.created_at, j.started_at, j.ended_at,
       CASE WHEN j.started_at IS NULL OR j.ended_at IS NULL THEN NULL
            ELSE greatest(0, CAST(floor((epoch_us(j.ended_at) - epoch_us(j.started_at)) / 1000) AS BIGINT)) END
         AS duration_ms,
       CAST(greatest(0, coalesce(a.n_total, 0) - coalesce(a.n_failed, 0)) AS BIGINT) AS n_models_success,
       CAST(coalesce(a.n_failed, 0) AS BIGINT) AS n_models_failed,
       b.best_algo, b.best_metric
FROM s_jobs j JOIN s_projects p ON p.project_id = j.project_id
LEFT JOIN agg a ON a.training_job_id = j.training_job_id
LEFT JOIN best b ON b.training_job_id = j.training_job_id
ORDER BY j.created_at DESC, j.training_job_id DESC LIMIT 200""")


@register("training_history", sql=_TH_SQL)
def q_training_history(spark, sf):
    """Newest 200 jobs with project, model success/failure counts and best model."""
    return H.training_history(standin(spark, sf, "s_jobs"), standin(spark, sf, "s_projects"), standin(spark, sf, "s_models"),
                              order_cols=("model_line", "model_price"))


@register("job_duration_ms", sql=with_standins(["s_jobs"], """
SELECT training_job_id,
       CASE WHEN started_at IS NULL OR ended_at IS NULL THEN NULL
            ELSE greatest(0, CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000) AS BIGINT)) END
         AS duration_ms
FROM s_jobs"""))
def q_job_duration(spark, sf):
    """Job duration in ms, clamped at 0, NULL while running."""
    j = standin(spark, sf, "s_jobs")
    return j.select("training_job_id", H.duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"))


@register("prediction_history", sql=with_standins(["s_predictions", "s_pmodels", "s_pjobs", "s_pprojects"], """
SELECT pr.model_id, pr.line, pr.price, pr.status, pr.input_type, pr.created_at, m.algorithm_name,
       j.training_job_id, p.project_id, p.project_name
FROM s_predictions pr JOIN s_pmodels m ON m.model_id = pr.model_id
JOIN s_pjobs j ON j.training_job_id = m.training_job_id
JOIN s_pprojects p ON p.project_id = j.project_id
WHERE pr.status = 'completed'
ORDER BY pr.created_at DESC, pr.model_id DESC, pr.price DESC LIMIT 200"""))
def q_prediction_history(spark, sf):
    """Newest 200 completed predictions with model, job and project (3 joins)."""
    out = H.prediction_history(standin(spark, sf, "s_predictions"), standin(spark, sf, "s_pmodels"),
                               standin(spark, sf, "s_pjobs"), standin(spark, sf, "s_pprojects"),
                               order_cols=("model_id", "price"), status="completed")
    return out.select("model_id", "line", "price", "status", "input_type", "created_at", "algorithm_name",
                      "training_job_id", "project_id", "project_name")


@register("recent_failures", sql=with_standins(["s_audit"], """
SELECT audit_log_id, action_type, target_type, target_id, action_time FROM s_audit
WHERE action_type LIKE '%_failed' ORDER BY action_time DESC, audit_log_id DESC LIMIT 50"""))
def q_recent_failures(spark, sf):
    """Newest 50 '*_failed' audit entries."""
    return H.recent_failures(standin(spark, sf, "s_audit")).select(
        "audit_log_id", "action_type", "target_type", "target_id", "action_time")


@register("audit_query", sql=with_standins(["s_audit"], """
SELECT audit_log_id, user_id, action_type, target_type, target_id, action_time FROM s_audit
WHERE target_type = 'Model' AND action_time >= TIMESTAMP '2024-01-05 00:00:00'
ORDER BY action_time DESC, audit_log_id DESC LIMIT 100 OFFSET 20"""))
def q_audit_query(spark, sf):
    """Audit log page: target filter + time filter, newest first, OFFSET 20 LIMIT 100."""
    a = H.audit_query(standin(spark, sf, "s_audit"), target_type="Model", since="2024-01-05 00:00:00",
                      limit=100, offset=20)
    return a.select("audit_log_id", "user_id", "action_type", "target_type", "target_id", "action_time")


_PC = """,
ds AS (SELECT project_id, count(*) AS n FROM s_datasets GROUP BY project_id),
jb AS (SELECT project_id, count(*) AS n FROM s_jobs GROUP BY project_id),
md AS (SELECT j.project_id, count(*) AS n FROM s_models m JOIN s_jobs j ON j.training_job_id = m.training_job_id
       GROUP BY j.project_id),
pc AS (SELECT p.*, CAST(coalesce(ds.n, 0) AS BIGINT) AS dataset_count, CAST(coalesce(jb.n, 0) AS BIGINT) AS job_count,
              CAST(coalesce(md.n, 0) AS BIGINT) AS model_count
       FROM s_projects p LEFT JOIN ds ON ds.project_id = p.project_id LEFT JOIN jb ON jb.project_id = p.project_id
       LEFT JOIN md ON md.project_id = p.project_id)"""


@register("project_counts", sql=with_standins(["s_projects", "s_datasets", "s_jobs", "s_models"], _PC + """
SELECT project_id, project_name, created_at, dataset_count, model_count FROM pc"""))
def q_project_counts(spark, sf):
    """Every project with dataset and model counts (0 when none)."""
    return H.project_counts(standin(spark, sf, "s_projects"), standin(spark, sf, "s_datasets"),
                            standin(spark, sf, "s_jobs"), standin(spark, sf, "s_models"))


@register("dependents_guard", sql=with_standins(["s_projects", "s_datasets", "s_jobs", "s_models"], _PC + """
SELECT project_id, dataset_count, job_count, model_count,
       dataset_count = 0 AND job_count = 0 AND model_count = 0 AS deletable FROM pc"""))
def q_dependents_guard(spark, sf):
    """Per project: dependent counts and whether a non-cascading delete is allowed."""
    return H.dependents_guard(standin(spark, sf, "s_projects"), standin(spark, sf, "s_datasets"),
                              standin(spark, sf, "s_jobs"), standin(spark, sf, "s_models"))


@register("recent_projects", sql=with_standins(["s_projects"], """
SELECT project_id, project_name, created_at FROM s_projects ORDER BY created_at DESC, project_id DESC LIMIT 3"""))
def q_recent_projects(spark, sf):
    """The three newest projects."""
    return H.recent_projects(standin(spark, sf, "s_projects")).select("project_id", "project_name", "created_at")


@register("models_by_project", sql=with_standins(["s_models", "s_jobs"], f"""
SELECT m.training_job_id, m.model_line, m.model_price, m.algorithm_name, m.metric_score, m.created_at, j.project_id
FROM s_models m JOIN s_jobs j ON j.training_job_id = m.training_job_id WHERE j.project_id = {PROJECT_ID}"""))
def q_models_by_project(spark, sf):
    """Models of one project (through their job), newest first."""
    m = standin(spark, sf, "s_models").withColumn("model_id", F.col("model_price"))
    out = H.models_by_project(m, standin(spark, sf, "s_jobs"), project_id=PROJECT_ID)
    return out.select("training_job_id", "model_line", "model_price", "algorithm_name", "metric_score",
                      "created_at", "project_id")


@register("models_by_job", sql=with_standins(["s_models"], """
SELECT training_job_id, model_line, model_price, metric_score,
       row_number() OVER (PARTITION BY training_job_id ORDER BY metric_score DESC NULLS LAST, model_line, model_price)
         AS rank
FROM s_models"""))
def q_models_by_job(spark, sf):
    """Models per job ordered by score desc NULLS LAST, then id."""
    m = H.models_by_job(standin(spark, sf, "s_models"), order_cols=("model_line", "model_price"))
    return m.select("training_job_id", "model_line", "model_price", "metric_score", "rank")


@register("mark_best", sql=with_standins(["s_models"], "," + _models_sql_cte() + """
SELECT training_job_id, model_line, model_price, is_best FROM s_mb"""))
def q_mark_best(spark, sf):
    """Exactly one best (scored) model per job as a derived flag."""
    return _models(spark, sf).select("training_job_id", "model_line", "model_price", "is_best")


@register("find_best_model", sql=with_standins(["s_models"], "," + _models_sql_cte() + """
SELECT training_job_id, algorithm_name, metric_score FROM s_mb WHERE is_best"""))
def q_find_best_model(spark, sf):
    """Best model of every job."""
    return H.find_best_model(_models(spark, sf)).select("training_job_id", "algorithm_name", "metric_score")


@register("job_status_fold", sql=with_standins(["s_status_events"], """
SELECT job_id, arg_max(status, (ts, event_id)) AS status,
       min(ts) FILTER (WHERE status = 'running') AS started_at,
       min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS ended_at,
       count(*) AS n_events
FROM s_status_events GROUP BY job_id"""))
def q_job_status_fold(spark, sf):
    """Fold an append-only status event log into current job rows."""
    return H.job_status_fold(standin(spark, sf, "s_status_events"))


@register("run_log_concat", sql=with_standins(["s_status_events"], """
SELECT job_id, string_agg(CASE WHEN suffix(line, chr(10)) THEN line ELSE line || chr(10) END, ''
                          ORDER BY ts, event_id) AS run_log,
       count(*) AS n_lines
FROM s_status_events GROUP BY job_id"""))
def q_run_log_concat(spark, sf):
    """Per-job run log: lines newline-terminated, in time order."""
    return H.run_log_concat(standin(spark, sf, "s_status_events"))


@register("metric_json_extract", sql="""
SELECT event_id, 'success' AS status,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_k,
       CAST(len(json_keys(props)) AS INTEGER) AS n_metrics,
       CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS train_time_ms
FROM events""")
def q_metric_json_extract(spark, sf):
    """Status / numeric metrics / error / time from a metric-summary JSON column."""
    from tabforge.plans.standins import table

    out = H.metric_json_extract(table(spark, sf, "events").select("event_id", "props"), "props")
    return out.select("event_id", "status", F.col("metrics")["k"].alias("metric_k"),
                      F.size("metrics").alias("n_metrics"), "error", "train_time_ms")


@register("duplicate_names", sql="""
SELECT trim(p_name) AS normalized_name, count(*) AS n_projects,
       length(trim(p_name)) BETWEEN 1 AND 100 AS valid_length
FROM part GROUP BY trim(p_name) HAVING count(*) > 1""")
def q_duplicate_names(spark, sf):
    """Normalized names used more than once (part names as project names)."""
    from tabforge.plans.standins import table

    p = table(spark, sf, "part").select(F.col("p_name").alias("project_name"))
    return H.duplicate_names(p)


@register("jobs_of_project", sql=with_standins(["s_jobs"], """
SELECT training_job_id, project_id, status, created_at FROM s_jobs
WHERE project_id = (SELECT min(project_id) FROM s_jobs)
ORDER BY created_at DESC, training_job_id DESC LIMIT 20 OFFSET 5"""))
def q_jobs_of_project(spark, sf):
    """A project's training jobs, newest first: 20 of them after the first 5."""
    j = standin(spark, sf, "s_jobs")
    first = j.agg(F.min("project_id")).first()[0]  # stands for the project a user picked
    return H.newest_of(j, "project_id", first, "training_job_id", limit=20, offset=5).select(
        "training_job_id", "project_id", "status", "created_at")


@register("run_log_lines", sql=with_standins(["s_status_events"], """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS line_no, line FROM s_status_events"""))
def q_run_log_lines(spark, sf):
    """Per-job run log as numbered lines."""
    return H.run_log_lines(standin(spark, sf, "s_status_events"))


@register("mark_best_min", sql=with_standins(["s_models"], """
SELECT training_job_id, model_line, model_price, metric_score,
  metric_score IS NOT NULL AND row_number() OVER (PARTITION BY training_job_id
    ORDER BY metric_score NULLS LAST, model_line, model_price) = 1 AS is_best FROM s_models"""))
def q_mark_best_min(spark, sf):
    """The best model of each job when a smaller score is better."""
    marked = H.mark_best(standin(spark, sf, "s_models"), order_cols=("model_line", "model_price"), direction="min")
    return marked.select("training_job_id", "model_line", "model_price", "metric_score", "is_best")


_SUMMARY = """CASE event_type
  WHEN 'error' THEN concat('{"status": "failed", "error": "scoring failed: x", "train_time_ms": ', CAST(event_id AS VARCHAR(20)), '}')
  WHEN 'signup' THEN concat('{"metrics": {"f1": 0.5, "note": "x", "n": ', CAST(event_id AS VARCHAR(20)), '}, "train_time_ms": 3}')
  WHEN 'click' THEN '{"metrics": {}, "train_time_ms": null}'
  ELSE '{"accuracy": 0.25, "train_time_ms": 7}' END"""


@register("metric_json_nested", sql=f"""
WITH e AS (SELECT event_id, {_SUMMARY} AS j FROM events),
m AS (SELECT *, CASE WHEN json_exists(j, '$.metrics') THEN json_extract(j, '$.metrics') ELSE j END AS src FROM e),
v AS (SELECT *, TRY_CAST(json_extract_string(src, '$.f1') AS DOUBLE) AS f1, TRY_CAST(json_extract_string(src, '$.n') AS DOUBLE) AS n,
  TRY_CAST(json_extract_string(src, '$.accuracy') AS DOUBLE) AS accuracy FROM m)
SELECT event_id, f1, n, accuracy, json_extract_string(j, '$.error') AS error,
  TRY_CAST(json_extract_string(j, '$.train_time_ms') AS BIGINT) AS train_time_ms,
  coalesce(json_extract_string(j, '$.status'), CASE WHEN coalesce(f1, n, accuracy) IS NOT NULL THEN 'success' ELSE 'failed' END) AS status
FROM v""")
def q_metric_json_nested(spark, sf):
    """Nested metrics, text among them, errors and explicit or implied status out of metric summaries."""
    rows = table(spark, sf, "events").select("event_id", F.expr(_SUMMARY).alias("j"))
    out = H.metric_json_extract(rows, "j")
    return out.select("event_id", *[F.col("metrics")[m].alias(m) for m in ("f1", "n", "accuracy")], "error", "train_time_ms", "status")
