"""Materialised dataset profile: computed once at upload, stored as JSON lines
next to the data (one small file), read back instead of recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILE_SCHEMA = ("n_rows long, column_idx int, name string, dtype string, n_missing long, n_unique long, "
                  "missing_ratio double, unique_ratio double")


def save_profile(prof: DataFrame, path: str) -> str:
    """Write a profile (one row per column — small) as one JSON-lines file."""
    prof.coalesce(1).write.mode("overwrite").json(path)
    return path


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)
