"""Saved models and the table that lists them.

A run writes its models under a new folder and, last of all, its registry rows. Readers
take the latest run that has registry rows, so a run that fails half way leaves the
previous models in use, and nothing is deleted beforehand.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.functions import storage_name
from countcast.operators.metrics import with_best
from countcast.spec import REGISTRY_SCHEMA

_STORED = T.StructType([*REGISTRY_SCHEMA, T.StructField("run_id", T.StringType())])


def model_folder(name: str) -> str:
    """As ``storage_name``, for a name held by the driver."""
    return name.lower().translate(str.maketrans(" -", "__"))


def new_run_id() -> str:
    """Sorts by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


def save_run(
    models: dict[str, PipelineModel], metrics: DataFrame, root: str, run_id: str | None = None
) -> str:
    """Save every fitted chain in a folder of its own, then the registry rows."""
    run_id = run_id or new_run_id()
    for name, model in models.items():
        model.write().overwrite().save(f"{root}/runs/{run_id}/{model_folder(name)}")
    write_registry(metrics, root, run_id)
    return run_id


def write_registry(metrics: DataFrame, root: str, run_id: str) -> None:
    """One JSON file with a row per model. A repeated run id replaces its own rows only."""
    path = F.concat(F.lit(f"{root}/runs/{run_id}/"), storage_name(F.col("model")))
    rows = with_best(metrics.select("model", path.alias("path"), "rmse", "r2", "mae"))
    rows.coalesce(1).write.mode("overwrite").json(f"{root}/registry/run_id={run_id}")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """The latest run's models with their metrics."""
    runs = spark.read.schema(_STORED).json(f"{root}/registry")
    latest = runs.agg(F.max("run_id")).first()[0]
    return runs.filter(F.col("run_id") == latest).drop("run_id")


def registry_document(registry: DataFrame) -> DataFrame:
    """The registry as one nested row: ``best_model`` and ``models`` by name."""
    details = F.struct(
        "path", F.col("rmse").alias("RMSE"), F.col("r2").alias("R2"), F.col("mae").alias("MAE")
    )
    return registry.agg(
        F.max_by("model", "is_best").alias("best_model"),
        F.map_from_entries(F.collect_list(F.struct(F.col("model"), details))).alias("models"),
    )


def choose_model(registry: DataFrame, model_name: str | None = None) -> tuple[str, str]:
    """(name, path) of the named model, or of the best one."""
    rows = registry.collect()  # one row per model
    for row in rows:
        if row.model == model_name or (not model_name and row.is_best):
            return row.model, row.path
    raise ValueError(f"unknown model {model_name!r}; available: {[r.model for r in rows]}")


def load_model(registry: DataFrame, model_name: str | None = None) -> tuple[str, PipelineModel]:
    name, path = choose_model(registry, model_name)
    return name, PipelineModel.load(path)


def load_models(registry: DataFrame) -> tuple[dict[str, PipelineModel], str]:
    """All models of the registry, and the name of the best."""
    rows = registry.collect()  # one row per model
    models = {r.model: PipelineModel.load(r.path) for r in rows}
    return models, next(r.model for r in rows if r.is_best)
