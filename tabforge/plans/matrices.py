"""Design matrices for the training queries: split → fit preprocessing on the
training side → one projection → vector column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import preprocess as PP
from tabforge.operators.split import split_random, split_stratified
from tabforge.operators.train import assemble
from tabforge.plans.config import PreprocessingConfig
from tabforge.plans.standins import standin, table


@dataclass
class Matrix:
    train: DataFrame  # id, features, label
    test: DataFrame
    model: PP.PreprocessorModel
    id_col: str
    task: str
    original: DataFrame


def build_matrix(df: DataFrame, *, id_col: str, target: str, task: str, excluded=(), config=None,
                 test_size: float = 0.2) -> Matrix:
    if task == "classification":
        sp, _ = split_stratified(df, id_col, target, test_size)
    else:
        sp = split_random(df, id_col, test_size)
    num, cat, dt, bl = PP.columns_by_role(df, target, [id_col, *excluded])
    pre = PP.Preprocessor(config or PreprocessingConfig(), num, cat, dt, bl).plan_routing(df)
    model = pre.fit(sp.where(~F.col("is_test")))
    mat = model.transform(sp, keep=[id_col, "is_test", target])
    mat = assemble(mat, model.output_columns).select(id_col, "is_test", "features", F.col(target).alias("label"))
    return Matrix(mat.where(~F.col("is_test")).drop("is_test"), mat.where(F.col("is_test")).drop("is_test"), model,
                  id_col, task, df)


def events_classification(spark, sf, config=None) -> Matrix:
    """Events (missing values injected): target = value above 45."""
    ev = standin(spark, sf, "s_ev")
    return build_matrix(ev, id_col="event_id", target="target", task="classification", excluded=["ts"], config=config)


def part_regression(spark, sf, config=None) -> Matrix:
    """Parts: predict the retail price from key, size, brand, type and name."""
    part = table(spark, sf, "part")
    return build_matrix(part, id_col="p_partkey", target="p_retailprice", task="regression", config=config,
                        excluded=[])
