"""Model bundle: everything that scoring needs, under one path.

Fitted preprocessing parameters, feature schema, metrics and optional config are JSON
files; the model is in Spark's own format, or its training rows where it is a
nearest-neighbour model; large encoding tables are Parquet files inside the bundle. A
bundle can be moved, and nothing outside it is read. All required parts must exist on
load.
"""

from __future__ import annotations

import copy
import json
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession

from tabforge.operators.preprocess import PreprocessorModel
from tabforge.operators.train import KNN, TrainedModel
from tabforge.operators.trees import TreeModel
from tabforge.plans.config import FeatureSchema, PreprocessingConfig
from tabforge.sources.files import exists, read_text, write_text

REQUIRED = ("model", "preprocessor.json", "feature_schema.json", "metrics.json")


def _save_model(spark: SparkSession, path: str, model: Model | TrainedModel) -> dict:
    """Write the model; returns what else is needed to load it."""
    if not isinstance(model, TrainedModel):
        model.write().overwrite().save(f"{path}/model")
        return {}
    if not model.is_success:
        raise ValueError(f"{model.name} is not a fitted model")
    if model.model == KNN:
        model.knn_train.write.mode("overwrite").parquet(f"{path}/model")
    elif isinstance(model.model, TreeModel):
        model.model.save(spark, f"{path}/model")
    else:
        PipelineModel(stages=[model.model]).write().overwrite().save(f"{path}/model")
    return {"name": model.name, "task": model.task, "classes": model.classes, "k": model.k, "knn": model.model == KNN,
            "trees": isinstance(model.model, TreeModel)}


def _load_model(spark: SparkSession, path: str, how: dict, model_cls: type) -> Model | TrainedModel:
    if not how:
        return model_cls.load(f"{path}/model")
    out = TrainedModel(how["name"], how["task"], "success", 0, classes=how["classes"], k=how["k"])
    if how["knn"]:
        out.model, out.knn_train = KNN, spark.read.parquet(f"{path}/model")
    elif how.get("trees"):
        out.model = TreeModel.load(spark, f"{path}/model")
    else:
        out.model = PipelineModel.load(f"{path}/model").stages[0]
    return out


def save_bundle(spark: SparkSession, path: str, *, model: Model | TrainedModel, pre: PreprocessorModel,
                schema: FeatureSchema, metrics: dict, config: PreprocessingConfig | None = None,
                meta: dict | None = None, vocabulary: DataFrame | None = None) -> str:
    """``vocabulary`` (column, value) holds the training categories of all categorical columns, however many."""
    how = _save_model(spark, path, model)
    if vocabulary is not None:
        schema = replace(schema, vocabulary="vocabulary")
        vocabulary.select("column", "value").write.mode("overwrite").parquet(f"{path}/{schema.vocabulary}")
    params = copy.deepcopy(pre.params)
    for i, entry in enumerate(e for e in params.get("categorical", {}).values() if e.get("table")):
        entry["table_path"] = f"tables/{i}"
        pre.tables[entry["table"]].write.mode("overwrite").parquet(f"{path}/{entry['table_path']}")
    parts = {
        "preprocessor": params, "feature_schema": schema.to_dict(), "metrics": metrics, "meta": meta or {}, "trained": how,
    }
    if config is not None:
        parts["config"] = config.to_dict()
    for name, value in parts.items():
        write_text(spark, f"{path}/{name}.json", json.dumps(value, ensure_ascii=False))
    return path


def load_bundle(spark: SparkSession, path: str, model_cls: type = PipelineModel):
    missing = [p for p in REQUIRED if not exists(spark, f"{path}/{p}")]
    if missing:
        raise FileNotFoundError(f"bundle {path} is missing {missing}")

    def part(name: str) -> dict:
        return json.loads(read_text(spark, f"{path}/{name}.json")) if exists(spark, f"{path}/{name}.json") else {}

    params = part("preprocessor")
    tables = {e["table"]: spark.read.parquet(f"{path}/{e['table_path']}")
              for e in params.get("categorical", {}).values() if e.get("table")}
    model = _load_model(spark, path, part("trained"), model_cls)
    return (model, PreprocessorModel(params, tables), FeatureSchema.from_dict(part("feature_schema")), part("metrics"),
            PreprocessingConfig.from_dict(part("config")), part("meta"))


def load_vocabulary(spark: SparkSession, path: str, schema: FeatureSchema) -> DataFrame:
    """(column, value): the categories that the bundle's model has seen."""
    if not schema.vocabulary:
        raise FileNotFoundError(f"bundle {path} has no vocabulary")
    return spark.read.parquet(f"{path}/{schema.vocabulary}")
