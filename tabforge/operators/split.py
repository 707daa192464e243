"""Reproducible train/test splits and class weights.

A row's place in the shuffle is ``hash32(key)`` (portable md5 prefix, ties by
key), so the split does not depend on partitioning, task retries or engine.
``n_test = ceil(n · test_size)``. Stratified: per class ``q = n_c·n_test/n``,
``floor(q)`` rows each, and the classes with the largest remainders (ties →
smaller label) take one more. Selection of "the k smallest hashes per class" is
exact and distributed (``flag_smallest``): a hot class is never ranked in one
task.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.columns import DEFAULT_SEED, hash32, q
from tabforge.functions.stats import MAX_CLASSES, flag_smallest


def _check(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")


def split_random(df: DataFrame, key_col: str, test_size: float = 0.2, seed: int = DEFAULT_SEED,
                 out: str = "is_test") -> DataFrame:
    """Flag ``ceil(n·test_size)`` rows (smallest hash of the key) as test."""
    _check(test_size)
    n_test = math.ceil(df.count() * test_size)
    hashed = df.withColumn("_h", hash32(q(key_col), seed))
    return flag_smallest(hashed, None, "_h", key_col, [(None, n_test)], out=out).drop("_h")


def class_counts(df: DataFrame, label_col: str) -> list[tuple[Any, int]]:
    """(class, rows) in class order. A label with more than ``MAX_CLASSES`` values is no class label and is refused."""
    rows = df.groupBy(label_col).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} values")
    return sorted(((r[0], r["count"]) for r in rows), key=lambda r: (r[0] is None, r[0]))


def stratified_allocation(counts: list[tuple[Any, int]], test_size: float) -> list[tuple[Any, int]]:
    """Test rows of each class (largest remainder, ties to the smaller class)."""
    n = sum(c for _, c in counts)
    n_test = math.ceil(n * test_size)
    quota = [c * n_test / n for _, c in counts]
    rest = n_test - sum(math.floor(x) for x in quota)
    favoured = set(sorted(range(len(counts)), key=lambda i: (math.floor(quota[i]) - quota[i], i))[:rest])
    return [(c, math.floor(quota[i]) + (i in favoured)) for i, (c, _) in enumerate(counts)]


def stratify_possible(counts: list[tuple[Any, int]], n_test: int) -> bool:
    """Every class has two rows, and either side has a row for every class."""
    n = sum(c for _, c in counts)
    return bool(counts) and min(c for _, c in counts) >= 2 and min(n_test, n - n_test) >= len(counts)


def split_stratified(df: DataFrame, key_col: str, label_col: str, test_size: float = 0.2,
                     seed: int = DEFAULT_SEED, out: str = "is_test") -> tuple[DataFrame, str]:
    """Stratified split; falls back to the random split when stratifying is
    impossible (a class with < 2 rows, or a side smaller than the class count).
    Returns (flagged frame, method used)."""
    _check(test_size)
    counts = class_counts(df, label_col)
    if not stratify_possible(counts, math.ceil(sum(c for _, c in counts) * test_size)):
        return split_random(df, key_col, test_size, seed, out), "random"
    hashed = df.withColumn("_h", hash32(q(key_col), seed))
    take = stratified_allocation(counts, test_size)
    return flag_smallest(hashed, label_col, "_h", key_col, take, out=out).drop("_h"), "stratified"


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weights w_c = n / (k · n_c) per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # one row per class
    return counts.select(label_col, (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row; the class count is checked before classes are broadcast."""
    counts = class_counts(df, label_col)
    n = sum(c for _, c in counts)
    kind = df.schema[label_col].dataType.simpleString()
    weights = df.sparkSession.createDataFrame(
        [(v, n / (len(counts) * c)) for v, c in counts if v is not None], f"`{label_col}` {kind}, `{out}` double")
    return df.join(F.broadcast(weights), on=label_col, how="left")
