"""End-to-end model comparison: roles → (drop rows) → routing on the full data →
split → preprocessing fitted on the training side → one cached matrix →
optional rebalancing → every selected algorithm → metrics → leaderboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import balance as B
from tabforge.operators import metrics as M
from tabforge.operators import preprocess as PP
from tabforge.operators import train as TR
from tabforge.operators.profile import category_vocab
from tabforge.operators.score import model_status, plot_data, score_models
from tabforge.operators.split import split_random, split_stratified, with_class_weight
from tabforge.plans.config import FeatureSchema, PreprocessingConfig, TrainingConfig
from tabforge.session import scratch_path
from tabforge.sources.bundle import save_bundle


ROW_KEY = "__row"


@dataclass
class TrainingRun:
    """``rows_without_target`` are left out of the split; ``key`` names the rows of both matrices."""

    leaderboard: DataFrame
    scores: DataFrame
    trained: list
    preprocessor: PP.PreprocessorModel
    schema: FeatureSchema
    metric_key: str
    split_method: str
    train_matrix: DataFrame
    test_matrix: DataFrame
    key: str
    rows_without_target: int
    config: PreprocessingConfig
    vocabulary: DataFrame  # every category of every categorical column

    def best(self) -> TR.TrainedModel:
        name = self.leaderboard.where("is_best").first()["algo"]
        return next(t for t in self.trained if t.name == name)

    def plots(self) -> dict[str, DataFrame]:
        """Confusion matrix (classification) or true-against-predicted sample (regression) of every fitted model."""
        return {t.name: plot_data(t, self.test_matrix, id_col=self.key) for t in self.trained if t.is_success}

    def save(self, path: str) -> str:
        """The best model as a bundle."""
        best = self.best()
        return save_bundle(self.scores.sparkSession, path, model=best, pre=self.preprocessor, schema=self.schema,
                           metrics={r["metric"]: r["value"] for r in self.scores.where(F.col("algo") == best.name).collect()},
                           config=self.config, vocabulary=self.vocabulary)


def keyed(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """The table and the name of its row key; a table without one is numbered once and written."""
    if key is not None:
        if key not in df.columns:
            raise ValueError(f"key_column({key}) is not in the data")
        return df, key
    path = scratch_path(df.sparkSession, "numbered")
    df.withColumn(ROW_KEY, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), ROW_KEY


def run_training(df: DataFrame, cfg: TrainingConfig, *, overrides: dict | None = None,
                 max_fit_rows: int | None = None) -> TrainingRun:
    if cfg.target_column not in df.columns:
        raise ValueError(f"target_column({cfg.target_column}) is not in the data")
    df, key = keyed(df, cfg.key_column)
    pcfg = cfg.preprocessing or PreprocessingConfig()
    specs = TR.get_specs(cfg.task_type, cfg.algorithms)
    metric_key = cfg.metric_key or specs[0].default_metric
    if metric_key not in M.METRIC_DIRECTIONS:
        raise ValueError(f"unknown metric: {metric_key}")
    num, cat, dt, bl = PP.columns_by_role(df, cfg.target_column, [key, *cfg.excluded_columns])
    data = df.where(F.col(cfg.target_column).isNotNull())
    without = df.where(F.col(cfg.target_column).isNull()).count()
    if pcfg.numeric_impute == "drop_rows":
        data = PP.drop_missing_rows(data, num)
    pre = PP.Preprocessor(pcfg, num, cat, dt, bl).plan_routing(data)
    if cfg.task_type == "classification":
        sp, method = split_stratified(data, key, cfg.target_column, cfg.test_size)
    else:
        sp, method = split_random(data, key, cfg.test_size), "random"
    sp = sp.persist()
    model = pre.fit(sp.where(~F.col("is_test")))
    schema = PP.build_feature_schema(data, num, cat, dt, bl, cfg.target_column, pcfg, pre.routing)
    mat = TR.assemble(model.transform(sp, keep=[key, "is_test", cfg.target_column]), model.output_columns)
    mat = mat.select(key, "is_test", "features", F.col(cfg.target_column).alias("label"))
    train = mat.where(~F.col("is_test")).drop("is_test")
    test = mat.where(F.col("is_test")).drop("is_test")
    weight_col = None
    if cfg.task_type == "classification" and pcfg.imbalance == "class_weight":
        train, weight_col = with_class_weight(train, "label", "weight"), "weight"
    elif cfg.task_type == "classification" and pcfg.imbalance == "smote":
        arr = train.select(key, "label", vector_to_array("features").alias("vec"))
        res = B.smote_resample(arr, id_col=key, label_col="label", vec_col="vec", k=pcfg.smote_k_neighbors)
        train = res.select(key, array_to_vector("vec").alias("features"), "label")
    trained = TR.train_all(specs, train, cfg.task_type, id_col=key, overrides=overrides, weight_col=weight_col,
                           k_neighbors=5, max_fit_rows=max_fit_rows)
    scores = score_models(trained, test, cfg.task_type, id_col=key)
    sp.unpersist()  # the matrices are computed anew where they are asked for again
    metrics = M.CLASSIFICATION_METRICS if cfg.task_type == "classification" else M.REGRESSION_METRICS
    lb = M.leaderboard(scores.where(F.col("metric").isNotNull()), model_status(scores), metric_key, list(metrics))
    return TrainingRun(lb, scores, trained, model, schema, metric_key, method, train, test, key, without, pcfg,
                       category_vocab(data, schema.categorical))
