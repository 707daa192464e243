"""Run-history analytics over the metadata tables.

Inputs are DataFrames with the metadata column names (projects, datasets,
training_jobs, models, prediction_jobs, audit_logs). Per-entity counts are
pre-aggregated before they are joined (one shuffle per side instead of N+1
lookups); filters are plain predicates that Catalyst pushes into the scans;
"newest N" lists are top-k sorts (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (reference).
STATUSES = ("pending", "running", "completed", "failed")
DEFAULT_HISTORY_LIMIT = 200
DEFAULT_FAILURE_LIMIT = 50
DEFAULT_AUDIT_LIMIT = 100
NAME_MAX_LEN = 100
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "all": None}


def _check_limit(limit: int) -> int:
    if limit <= 0:
        raise ValueError("limit must be >= 1")
    return int(limit)


def _check_status(status: str | None) -> None:
    if status is not None and status not in STATUSES:
        raise ValueError(f"status not allowed: {status} (allowed: {sorted(STATUSES)})")


def history_filter(df: DataFrame, *, project_col: str = "project_id", time_col: str = "created_at",
                   project_id: int | None = None, status: str | None = None,
                   since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Optional equality filters plus a half-open [since, until) time window."""
    _check_status(status)
    if project_id is not None:
        df = df.where(F.col(project_col) == F.lit(int(project_id)))
    if status is not None:
        df = df.where(F.col("status") == F.lit(status))
    if since is not None:
        df = df.where(F.col(time_col) >= F.lit(since).cast(df.schema[time_col].dataType))
    if until is not None:
        df = df.where(F.col(time_col) < F.lit(until).cast(df.schema[time_col].dataType))
    return df


def like_failed(action_type: Column) -> Column:
    """``LIKE '%_failed'`` — '_' is a wildcard on purpose ('training.failed' matches)."""
    return action_type.like("%_failed")


def duration_ms(started: Column, ended: Column) -> Column:
    """max(0, ended − started) in ms; NULL when either end is missing."""
    # zone-independent difference (no cast to session-local time)
    d = F.timestamp_diff("MILLISECOND", started, ended)
    return F.when(started.isNotNull() & ended.isNotNull(), F.greatest(F.lit(0), d).cast("bigint"))


def period_filter(df: DataFrame, time_col: str, period: str, as_of: Column | datetime) -> DataFrame:
    """Rows newer than ``as_of`` − N days (7/30/90) or all rows."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"unknown period: {period}")
    days = PERIOD_DAYS[period]
    if days is None:
        return df
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where(F.col(time_col) >= ref - F.make_dt_interval(F.lit(days)))


def admin_stats(projects: DataFrame, datasets: DataFrame, jobs: DataFrame, models: DataFrame,
                predictions: DataFrame) -> DataFrame:
    """Five entity counts and the two failed-status counts, one row."""
    spark = projects.sparkSession

    def count(df: DataFrame, cond=None):
        agg = F.count(F.lit(1)) if cond is None else F.count_if(cond)
        return df.agg(agg).scalar()  # scalar subquery: one aggregate per table

    failed = F.col("status") == "failed"
    return spark.range(1).select(
        count(projects).alias("projects"), count(datasets).alias("datasets"),
        count(jobs).alias("training_jobs"), count(jobs, failed).alias("training_failures"),
        count(models).alias("models"), count(predictions).alias("predictions"),
        count(predictions, failed).alias("prediction_failures"))


def mark_best(models: DataFrame, job_col: str = "training_job_id", score_col: str = "metric_score",
              order_cols: Sequence[str] = ("model_id",), direction: str = "max") -> DataFrame:
    """Derived ``is_best``: exactly one scored model per job — best score in the
    metric direction, ties to the first by ``order_cols``.

    The winner per job is a ``min_by`` aggregate (partially aggregated, so a job
    holding a third of all models is not ranked in one task), joined back on
    (job, order columns)."""
    s = F.col(score_col)
    signed = -s if direction == "max" else s
    key = F.struct(signed.alias("_s"), *[F.col(c) for c in order_cols])
    best = (models.where(s.isNotNull()).groupBy(job_col)
            .agg(F.min_by(F.struct(*[F.col(c) for c in order_cols]), key).alias("_b"))
            .select(job_col, *[F.col(f"_b.{c}").alias(c) for c in order_cols])
            .withColumn("_is_best", F.lit(True)))
    return models.join(best, on=[job_col, *order_cols], how="left").withColumn(
        "is_best", F.coalesce(F.col("_is_best"), F.lit(False))).drop("_is_best")


def training_history(jobs: DataFrame, projects: DataFrame, models: DataFrame, *, project_id: int | None = None,
                     status: str | None = None, since=None, until=None, order_cols: Sequence[str] = ("model_id",),
                     limit: int = DEFAULT_HISTORY_LIMIT) -> DataFrame:
    """Newest jobs with project name, per-job model counts and the best model.

    The list is cut before any model is looked at: left joins cannot remove jobs, so
    only the models of the ``limit`` listed jobs are aggregated. ``models`` need no
    best flag; without one, ``mark_best`` runs over these models by ``order_cols``.
    """
    _check_limit(limit)
    j = history_filter(jobs, project_id=project_id, status=status, since=since, until=until)
    newest = (
        j.join(projects.select("project_id", "project_name"), on="project_id", how="inner")
        .orderBy(F.col("created_at").desc(), F.col("training_job_id").desc())
        .limit(limit)
    )
    own = models.join(F.broadcast(newest.select("training_job_id")), on="training_job_id", how="left_semi")  # limit rows
    if "is_best" not in models.columns:
        own = mark_best(own, order_cols=order_cols)
    best = F.struct(F.col("algorithm_name").alias("algo"), F.col("metric_score").alias("score"))
    per_job = own.groupBy("training_job_id").agg(
        F.count_if(F.col("metric_score").isNull()).alias("n_failed"),
        F.count_if(F.col("metric_score").isNotNull()).alias("n_success"),
        F.max(F.when(F.col("is_best"), best)).alias("best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = newest.join(per_job, on="training_job_id", how="left").select(
        "training_job_id", "project_id", "project_name", "dataset_id", "task_type", "target_column",
        "metric_key", "status", "created_at", "started_at", "ended_at",
        duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        zero("n_success").alias("n_models_success"), zero("n_failed").alias("n_models_failed"),
        F.col("best.algo").alias("best_algo"), F.col("best.score").alias("best_metric"))
    return out.orderBy(F.col("created_at").desc(), F.col("training_job_id").desc())


def prediction_history(predictions: DataFrame, models: DataFrame, jobs: DataFrame, projects: DataFrame, *,
                       order_cols: Sequence[str] = ("prediction_job_id",), project_id: int | None = None,
                       status: str | None = None, since=None, until=None,
                       limit: int = DEFAULT_HISTORY_LIMIT) -> DataFrame:
    """prediction ⋈ model ⋈ job ⋈ project with filters, newest first."""
    _check_limit(limit)
    _check_status(status)
    pr = predictions
    if status is not None:
        pr = pr.where(F.col("status") == status)
    if since is not None:
        pr = pr.where(F.col("created_at") >= F.lit(since).cast(pr.schema["created_at"].dataType))
    if until is not None:
        pr = pr.where(F.col("created_at") < F.lit(until).cast(pr.schema["created_at"].dataType))
    m = models.select("model_id", F.col("algorithm_name"), "training_job_id")
    j = jobs.select("training_job_id", "project_id")
    if project_id is not None:
        j = j.where(F.col("project_id") == int(project_id))
    p = projects.select("project_id", "project_name")
    out = pr.join(m, on="model_id").join(j, on="training_job_id").join(p, on="project_id")
    order = [F.col("created_at").desc()] + [F.col(c).desc() for c in order_cols]
    return out.orderBy(*order).limit(limit)


def recent_failures(audit: DataFrame, *, since=None, until=None, limit: int = DEFAULT_FAILURE_LIMIT) -> DataFrame:
    """Audit entries whose action ends in '_failed' (LIKE semantics), newest first."""
    _check_limit(limit)
    a = audit.where(like_failed(F.col("action_type")))
    if since is not None:
        a = a.where(F.col("action_time") >= F.lit(since).cast(a.schema["action_time"].dataType))
    if until is not None:
        a = a.where(F.col("action_time") < F.lit(until).cast(a.schema["action_time"].dataType))
    return a.orderBy(F.col("action_time").desc(), F.col("audit_log_id").desc()).limit(limit)


def audit_query(audit: DataFrame, *, user_id: int | None = None, action_type: str | None = None,
                target_type: str | None = None, target_id: int | None = None, since=None, until=None,
                limit: int = DEFAULT_AUDIT_LIMIT, offset: int = 0) -> DataFrame:
    """Up to six optional filters, newest first, then OFFSET / LIMIT."""
    a = audit
    for col, val in (("user_id", user_id), ("action_type", action_type), ("target_type", target_type),
                     ("target_id", target_id)):
        if val is not None:
            a = a.where(F.col(col) == F.lit(val))
    if since is not None:
        a = a.where(F.col("action_time") >= F.lit(since).cast(a.schema["action_time"].dataType))
    if until is not None:
        a = a.where(F.col("action_time") < F.lit(until).cast(a.schema["action_time"].dataType))
    a = a.orderBy(F.col("action_time").desc(), F.col("audit_log_id").desc())
    if offset:
        a = a.offset(offset)
    return a.limit(limit)


def _per_project_counts(projects: DataFrame, datasets: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    ds = datasets.groupBy("project_id").agg(F.count(F.lit(1)).alias("dataset_count"))
    jb = jobs.groupBy("project_id").agg(F.count(F.lit(1)).alias("job_count"))
    # models reach a project through their job: aggregate per job first, then per project
    per_job = models.groupBy("training_job_id").agg(F.count(F.lit(1)).alias("n"))
    md = (per_job.join(jobs.select("training_job_id", "project_id"), on="training_job_id")
          .groupBy("project_id").agg(F.sum("n").alias("model_count")))
    return (
        projects.join(ds, on="project_id", how="left").join(jb, on="project_id", how="left")
        .join(md, on="project_id", how="left")
        .withColumn("dataset_count", F.coalesce("dataset_count", F.lit(0)).cast("bigint"))
        .withColumn("job_count", F.coalesce("job_count", F.lit(0)).cast("bigint"))
        .withColumn("model_count", F.coalesce("model_count", F.lit(0)).cast("bigint"))
    )


def project_counts(projects: DataFrame, datasets: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    """Every project with its dataset and model counts (0 when none), newest first."""
    c = _per_project_counts(projects, datasets, jobs, models)
    return c.select("project_id", "project_name", "created_at", "dataset_count", "model_count").orderBy(
        F.col("created_at").desc(), F.col("project_id").desc())


def recent_projects(projects: DataFrame, n: int = 3) -> DataFrame:
    return projects.orderBy(F.col("created_at").desc(), F.col("project_id").desc()).limit(n)


def models_by_project(models: DataFrame, jobs: DataFrame, project_id: int | None = None) -> DataFrame:
    """Models joined to their job's project, newest first."""
    j = jobs.select("training_job_id", "project_id")
    if project_id is not None:
        j = j.where(F.col("project_id") == int(project_id))
    return models.join(j, on="training_job_id").orderBy(F.col("created_at").desc(), F.col("model_id").desc())


def models_by_job(models: DataFrame, order_cols: Sequence[str] = ("model_id",)) -> DataFrame:
    """Per job, models by score desc NULLS LAST then id (desc even for error
    metrics, as the reference does); the 1-based position is returned as ``rank``.
    Positions come from ``with_position`` (one window for jobs up to 1M models,
    range partitioning beyond), so a hot job is not ranked in one task."""
    from tabforge.functions.stats import with_position

    order = [F.col("metric_score").desc_nulls_last(), *[F.col(c).asc() for c in order_cols]]
    out = with_position(models, ["training_job_id"], order, out="_pos")
    return out.withColumn("rank", (F.col("_pos") + 1).cast("bigint")).drop("_pos")


def find_best_model(models: DataFrame) -> DataFrame:
    return models.where(F.col("is_best"))


def job_status_fold(status_events: DataFrame, job_col: str = "job_id", time_col: str = "ts",
                    status_col: str = "status", id_col: str = "event_id") -> DataFrame:
    """Fold an append-only status event log into one current row per job:
    latest status, first time it entered running, first time it finished."""
    last = F.max_by(F.col(status_col), F.struct(F.col(time_col), F.col(id_col)))
    return status_events.groupBy(job_col).agg(
        last.alias("status"),
        F.min(F.when(F.col(status_col) == "running", F.col(time_col))).alias("started_at"),
        F.min(F.when(F.col(status_col).isin("completed", "failed"), F.col(time_col))).alias("ended_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def run_log_lines(lines: DataFrame, job_col: str = "job_id", line_col: str = "line", time_col: str = "ts",
                  id_col: str = "event_id") -> DataFrame:
    """(job, line_no, line): each job's lines numbered from 0 in (time, id) order.

    The log without its concatenation: a job with a third of all lines stays spread
    over the range partitions of ``with_position``.
    """
    from tabforge.functions.stats import with_position

    numbered = with_position(lines.select(job_col, line_col, time_col, id_col), [job_col], [time_col, id_col], out="line_no")
    return numbered.select(job_col, "line_no", line_col)


def run_log_concat(lines: DataFrame, job_col: str = "job_id", line_col: str = "line", time_col: str = "ts",
                   id_col: str = "event_id") -> DataFrame:
    """Per job: every line newline-terminated, concatenated in (time, id) order."""
    term = F.when(F.col(line_col).endswith("\n"), F.col(line_col)).otherwise(F.concat(F.col(line_col), F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("i"),
                                                   term.alias("l"))))
    return lines.groupBy(job_col).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "").alias("run_log"),
                                      F.count(F.lit(1)).alias("n_lines"))


def metric_json_extract(df: DataFrame, json_col: str) -> DataFrame:
    """status / metrics / error / train_time_ms out of a metric summary JSON.

    Metrics keep only numeric values; with no explicit status a row counts as
    success iff it has at least one metric.
    """
    parsed = F.from_json(F.col(json_col), "map<string,string>")
    reserved = ["status", "error", "train_time_ms", "metrics"]
    nested = F.from_json(F.get_json_object(F.col(json_col), "$.metrics"), "map<string,string>")
    flat = F.map_filter(parsed, lambda k, v: ~k.isin(*reserved))
    source = F.when(nested.isNotNull(), nested).otherwise(flat)
    numeric = F.map_filter(source, lambda k, v: v.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"))
    metrics = F.transform_values(numeric, lambda k, v: v.try_cast("double"))
    status = F.coalesce(F.get_json_object(F.col(json_col), "$.status"),
                        F.when(F.size(metrics) > 0, F.lit("success")).otherwise(F.lit("failed")))
    return df.select(
        "*",
        status.alias("status"),
        metrics.alias("metrics"),
        F.get_json_object(F.col(json_col), "$.error").alias("error"),
        F.get_json_object(F.col(json_col), "$.train_time_ms").try_cast("bigint").alias("train_time_ms"),
    )


def dependents_guard(projects: DataFrame, datasets: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    """Per project: dependent counts and whether deletion without cascade is allowed."""
    c = _per_project_counts(projects, datasets, jobs, models)
    free = (F.col("dataset_count") == 0) & (F.col("job_count") == 0) & (F.col("model_count") == 0)
    return c.select("project_id", "dataset_count", "job_count", "model_count", free.alias("deletable"))


def duplicate_names(projects: DataFrame, name_col: str = "project_name") -> DataFrame:
    """Normalized (trimmed, case-sensitive) names used more than once, plus
    whether the normalized name is valid (1..100 characters)."""
    n = F.trim(F.col(name_col))
    return (
        projects.groupBy(n.alias("normalized_name"))
        .agg(F.count(F.lit(1)).alias("n_projects"))
        .where(F.col("n_projects") > 1)
        .withColumn("valid_length", (F.length("normalized_name") >= 1) & (F.length("normalized_name") <= NAME_MAX_LEN))
    )


def newest_of(rows: DataFrame, parent_col: str, parent, key_col: str, *, time_col: str = "created_at",
              limit: int = DEFAULT_HISTORY_LIMIT, offset: int = 0) -> DataFrame:
    """A parent's rows (datasets or jobs of a project, predictions of a model), newest first, ties by key descending."""
    _check_limit(limit)
    if offset < 0:
        raise ValueError("offset must be 0 or more")
    own = rows.where(F.col(parent_col) == F.lit(parent))
    return own.orderBy(F.col(time_col).desc(), F.col(key_col).desc()).offset(offset).limit(limit)
