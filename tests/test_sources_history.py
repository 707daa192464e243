import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabforge.operators import history as H
from tabforge.sources import csv as CSV


def _csv(text):
    d = tempfile.mkdtemp(prefix="tabforge-csv-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write(text)
    return p


@pytest.mark.parametrize("text", ["a,,b\n1,2,3\n", "a,a\n1,2\n", "a,Unnamed: 1\n1,2\n"])
def test_bad_headers_rejected(spark, text):
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _csv(text))


def test_empty_file_rejected(spark):
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _csv(""))
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _csv("a,b\n"))


def test_na_tokens_and_types(spark):
    rows, bad = CSV.read_tabular(spark, _csv("x,y,z\n1,2.5,NA\n2,N/A,foo\n3,,bar\n"))
    assert dict(rows.dtypes) == {"x": "bigint", "y": "double", "z": "string"}
    assert [r["y"] for r in rows.orderBy("x").collect()] == [2.5, None, None]
    assert bad.count() == 0


def test_malformed_rows(spark):
    text = "a,b,c\n1,2,3\n4,5,6,7\n8,9\n1,2,3,\n5,,7,8,9\n"
    rows, bad = CSV.read_tabular(spark, _csv(text), strict=False)
    assert rows.count() == 2
    assert sorted(r["line"] for r in bad.collect()) == ["1,2,3,", "4,5,6,7", "5,,7,8,9"]  # whole, empty fields too
    assert [r["c"] for r in rows.orderBy("a").collect()] == [3, None]
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _csv(text))


def test_numbers_beyond_64_bits_and_booleans(spark):
    text = "id,flag,big,mixed\n12345678901234567890,True,1,True\n98765432109876543210,false,2,no\n"
    rows, _ = CSV.read_tabular(spark, _csv(text))
    assert dict(rows.dtypes) == {"id": "decimal(38,0)", "flag": "boolean", "big": "bigint", "mixed": "string"}
    got = rows.orderBy("big").collect()
    assert [int(r["id"]) for r in got] == [12345678901234567890, 98765432109876543210]
    assert [r["flag"] for r in got] == [True, False]


def test_quoted_line_breaks(spark):
    text = 'a,b\n1,"x\ny"\n2,z\n'
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _csv(text))
    rows, _ = CSV.read_tabular(spark, _csv(text), multi_line=True)
    assert [r["b"] for r in rows.orderBy("a").collect()] == ["x\ny", "z"]


def test_like_failed_wildcard(spark):
    df = spark.createDataFrame([("training.failed",), ("prediction_failed",), ("failed",), ("project.created",)], "a string")
    assert sorted(r[0] for r in df.where(H.like_failed(F.col("a"))).collect()) == ["prediction_failed", "training.failed"]


def test_duration_and_fold(spark):
    from datetime import datetime as dt
    df = spark.createDataFrame([(dt(2024, 1, 1, 0, 0, 1), dt(2024, 1, 1, 0, 0, 0)), (dt(2024, 1, 1), None)],
                               "s timestamp, e timestamp")
    assert [r[0] for r in df.select(H.duration_ms(F.col("s"), F.col("e"))).collect()] == [0, None]
    ev = spark.createDataFrame([(1, 7, dt(2024, 1, 1, 1), "pending"), (2, 7, dt(2024, 1, 1, 2), "running"),
                                (3, 7, dt(2024, 1, 1, 3), "running"), (4, 7, dt(2024, 1, 1, 4), "completed")],
                               "event_id long, job_id long, ts timestamp, status string")
    r = H.job_status_fold(ev).first()
    assert r["status"] == "completed" and r["started_at"] == dt(2024, 1, 1, 2) and r["ended_at"] == dt(2024, 1, 1, 4)
    log = H.run_log_concat(ev.withColumn("line", F.col("status"))).first()["run_log"]
    assert log == "pending\nrunning\nrunning\ncompleted\n"


def test_history_validation(spark):
    df = spark.createDataFrame([(1, "failed")], "project_id long, status string")
    with pytest.raises(ValueError):
        H.history_filter(df, status="exploded")
    with pytest.raises(ValueError):
        H.recent_failures(df, limit=0)


def test_streaming_fold_equals_batch(spark):
    from datetime import datetime as dt

    from tabforge.streaming.status_fold import current_status, start_status_fold

    base = tempfile.mkdtemp(prefix="tabforge-stream-")
    src, sink, ckpt = f"{base}/src", f"{base}/sink", f"{base}/ckpt"
    schema = "event_id long, job_id long, ts timestamp_ntz, status string"
    b1 = [(1, 7, dt(2024, 1, 1, 1), "pending"), (2, 7, dt(2024, 1, 1, 2), "running"), (3, 8, dt(2024, 1, 1, 1), "running")]
    b2 = [(4, 7, dt(2024, 1, 1, 4), "completed"), (5, 8, dt(2024, 1, 1, 5), "failed"), (6, 9, dt(2024, 1, 1, 6), "pending")]
    spark.createDataFrame(b1, schema).write.parquet(f"{src}/b1")
    q = start_status_fold(spark, f"{src}/*", sink, ckpt, schema=schema, available_now=True)
    q.awaitTermination()
    spark.createDataFrame(b2, schema).write.parquet(f"{src}/b2")
    q = start_status_fold(spark, f"{src}/*", sink, ckpt, schema=schema, available_now=True)  # restart from checkpoint
    q.awaitTermination()
    got = {r["job_id"]: (r["status"], r["started_at"], r["ended_at"], r["n_events"])
           for r in current_status(spark, sink).collect()}
    want = {r["job_id"]: (r["status"], r["started_at"], r["ended_at"], r["n_events"])
            for r in H.job_status_fold(spark.createDataFrame(b1 + b2, schema)).collect()}
    assert got == want


def _meta(spark):
    from datetime import datetime as dt
    projects = spark.createDataFrame([(1, "alpha", dt(2024, 1, 1)), (2, "beta", dt(2024, 2, 1))],
                                     "project_id long, project_name string, created_at timestamp")
    jobs = spark.createDataFrame(
        [(10, 1, 1, "classification", "y", "f1", "completed", dt(2024, 3, 1), dt(2024, 3, 1), dt(2024, 3, 1, 0, 0, 2)),
         (11, 1, 1, "classification", "y", "f1", "failed", dt(2024, 3, 2), dt(2024, 3, 2), dt(2024, 3, 2)),
         (12, 2, 2, "regression", "y", "rmse", "running", dt(2024, 3, 3), dt(2024, 3, 3), None)],
        "training_job_id long, project_id long, dataset_id long, task_type string, target_column string, "
        "metric_key string, status string, created_at timestamp, started_at timestamp, ended_at timestamp")
    models = spark.createDataFrame([(100, 10, "logistic", 0.7), (101, 10, "forest", 0.9), (102, 10, "knn", None)],
                                   "model_id long, training_job_id long, algorithm_name string, metric_score double")
    return projects, jobs, models


def test_training_history_joins(spark):
    projects, jobs, models = _meta(spark)
    rows = H.training_history(jobs, projects, H.mark_best(models)).collect()
    assert [r["training_job_id"] for r in rows] == [12, 11, 10]  # newest first
    r10 = rows[2]
    assert (r10["n_models_success"], r10["n_models_failed"], r10["best_algo"], r10["duration_ms"]) == (2, 1, "forest", 2000)
    assert rows[1]["n_models_success"] == 0 and rows[1]["best_algo"] is None  # no models → left join zeros
    assert rows[0]["duration_ms"] is None
    only = H.training_history(jobs, projects, H.mark_best(models), project_id=1, status="failed").collect()
    assert [r["training_job_id"] for r in only] == [11]


def test_project_counts_and_guard(spark):
    projects, jobs, models = _meta(spark)
    datasets = spark.createDataFrame([(1, 1)], "dataset_id long, project_id long")
    counts = {r["project_id"]: (r["dataset_count"], r["model_count"])
              for r in H.project_counts(projects, datasets, jobs, models).collect()}
    assert counts == {1: (1, 3), 2: (0, 0)}
    guard = {r["project_id"]: r["deletable"] for r in H.dependents_guard(projects, datasets, jobs, models).collect()}
    assert guard == {1: False, 2: False}  # project 2 still has a job


def test_bundle_round_trip(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tabforge.operators.preprocess import Preprocessor
    from tabforge.plans.config import FeatureSchema, PreprocessingConfig
    from tabforge.sources import bundle as BD

    df = spark.createDataFrame([(float(i), "ab"[i % 2], 2.0 * i + 1) for i in range(20)], "x double, c string, y double")
    pre = Preprocessor(PreprocessingConfig(), ["x"], ["c"]).fit(df)
    feats = VectorAssembler(inputCols=pre.output_columns, outputCol="features").transform(pre.transform(df, keep=["y"]))
    model = PipelineModel(stages=[LinearRegression(labelCol="y", solver="normal").fit(feats)])
    path = tempfile.mkdtemp(prefix="tabforge-bundle-") + "/b"
    schema = FeatureSchema(numeric=("x",), categorical=("c",), target="y")
    BD.save_bundle(spark, path, model=model, pre=pre, schema=schema, metrics={"rmse": 0.0})
    m2, pre2, schema2, metrics, config, _ = BD.load_bundle(spark, path)
    assert schema2 == schema and metrics == {"rmse": 0.0} and config == PreprocessingConfig()
    a = [r[0] for r in model.transform(feats).select("prediction").collect()]
    feats2 = VectorAssembler(inputCols=pre2.output_columns, outputCol="features").transform(pre2.transform(df, keep=["y"]))
    b = [r[0] for r in m2.transform(feats2).select("prediction").collect()]
    assert a == b
    os.remove(path + "/metrics.json")
    with pytest.raises(FileNotFoundError):
        BD.load_bundle(spark, path)


def test_models_by_job_distributed_path(spark, monkeypatch):
    from pyspark.sql import Window

    from tabforge.functions import stats as S

    rows = [(i % 3, i, None if i % 7 == 0 else float((i * 37) % 11)) for i in range(300)]
    models = spark.createDataFrame(rows, "training_job_id long, model_id long, metric_score double")
    monkeypatch.setattr(S, "DIRECT_RANK_LIMIT", 10)
    got = {r["model_id"]: r["rank"] for r in H.models_by_job(models).collect()}
    w = Window.partitionBy("training_job_id").orderBy(F.col("metric_score").desc_nulls_last(), "model_id")
    want = {r["model_id"]: r["r"] for r in models.select("model_id", F.row_number().over(w).alias("r")).collect()}
    assert got == want
    best = {r["training_job_id"]: r["model_id"] for r in H.mark_best(models).where("is_best").collect()}
    want_best = {r["training_job_id"]: r["model_id"]
                 for r in models.select("training_job_id", "model_id", F.row_number().over(w).alias("r")).where("r = 1").collect()}
    assert best == want_best
