"""Flagship query: a full model comparison on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabforge.plans.config import PreprocessingConfig, TrainingConfig
from tabforge.plans.standins import standin
from tabforge.plans.training_run import run_training

FLAGSHIP_ALGORITHMS = ("logistic_regression", "decision_tree", "random_forest", "kneighbors")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events (with missing values) → roles → median/standard + mode/one-hot +
    datetime parts → stratified split → four algorithms → metrics → leaderboard."""
    ev = standin(spark, sf_dir, "s_ev")
    cfg = TrainingConfig(
        task_type="classification", target_column="target", excluded_columns=("ts",), key_column="event_id",
        algorithms=FLAGSHIP_ALGORITHMS,
        preprocessing=PreprocessingConfig(outlier="iqr_clip", datetime_decompose=True,
                                          datetime_parts=("hour", "weekday", "is_weekend")))
    return run_training(ev, cfg).leaderboard
