"""Headline-query benchmark.

Runs a fixed set of registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is forced to completion with the no-op sink (full computation, no
collection to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile",  # upload + profile in the reference's timing
    "csv_scan",  # parse + header guards + type inference
    "preview_rows",
    "design_matrix",  # preprocessing fitted on the training split
    "split_stratified",
    "metric_roc_auc_binary",
    "confusion_matrix",
    "train_kneighbors_clf",
    "smote",
    "train_all",  # all classification specs on one matrix
    "predict_batch",
    "training_history",
    "prediction_history",
    "project_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tabforge.plans.registry import load_all
    from tabforge.session import build_session

    spark = build_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    reg = load_all()
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in reg]
    # warm-up: JVM, parquet readers
    reg["admin_stats"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.perf_counter()
        reg[k].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
    if not sys.argv[1:]:
        # the reference re-reads the stored profile instead of recomputing it
        from tabforge.operators.profile import profile
        from tabforge.session import scratch_path
        from tabforge.sources.profile_store import load_profile, save_profile

        path = save_profile(profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet")), scratch_path(spark, "profile"))
        t0 = time.perf_counter()
        load_profile(spark, path).collect()
        times["read_stored_profile"] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
