"""Scoring request tables with fitted models.

Scoring is row-local: any number of models is applied in one pass over the requests,
without a shuffle, and results stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.functions import count_prediction, numeric_year, two_decimals
from countcast.operators.features import with_year
from countcast.sources.facts import requests_from_rows
from countcast.spec import CountSpec


def reject_reason(spec: CountSpec) -> Column:
    """Why a request cannot be scored, or null."""
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for dim in spec.dims:
        reason = reason.when(F.col(dim).isNull(), f"missing {dim}")
    if spec.year_dim is not None:
        reason = reason.when(numeric_year(F.col(spec.year_dim)).isNull(), "malformed year")
    return reason


def valid_requests(requests: DataFrame, spec: CountSpec) -> DataFrame:
    """Requests without a reject reason, as separate conditions that reach the scans."""
    valid = requests.dropna("any", subset=list(spec.dims)) if spec.dims else requests
    if spec.year_dim is None:
        return valid
    return valid.filter(numeric_year(F.col(spec.year_dim)).isNotNull())


def rejected_requests(requests: DataFrame, spec: CountSpec) -> DataFrame:
    return requests.withColumn("reason", reject_reason(spec)).filter("reason is not null")


def apply_models(df: DataFrame, spec: CountSpec, models: Mapping[str, PipelineModel]) -> tuple[DataFrame, dict[str, str]]:
    """Adds one count prediction column per model; returns the frame and name -> column.

    Each model's intermediate columns are dropped before the next one is applied, so the
    plan is one chain of projections over a single scan.
    """
    kept = df.columns
    scored = df
    columns: dict[str, str] = {}
    for i, (name, model) in enumerate(models.items()):
        column = f"prediction_{i}"
        transformed = model.transform(with_year(scored, spec))
        scored = transformed.select(
            *kept, *columns.values(), count_prediction(F.col("prediction")).alias(column)
        )
        columns[name] = column
    return scored, columns


def score(requests: DataFrame, spec: CountSpec, model: PipelineModel) -> DataFrame:
    """Valid requests, all their columns, and ``final_prediction``. Any year or label the
    model has not seen is scored through its unseen bucket."""
    scored, _ = apply_models(valid_requests(requests, spec), spec, {"model": model})
    return scored.withColumnRenamed("prediction_0", "final_prediction")


def answered(requests: DataFrame, spec: CountSpec, model: PipelineModel) -> DataFrame:
    """Every request with ``final_prediction`` or, where it cannot be scored, a ``reason``.

    One pass: faulty requests go through the model under labels it has never seen, and their
    predictions are then discarded.
    """
    asked = requests.withColumn("reason", reject_reason(spec)).withColumn("asked", F.struct(*spec.dims))
    safe = asked.withColumns({d: F.when(F.col("reason").isNull(), F.col(d)).otherwise(F.lit("0000")) for d in spec.dims})
    scored, _ = apply_models(safe, spec, {"model": model})
    kept = [F.col(f"asked.{c}").alias(c) if c in spec.dims else F.col(c) for c in requests.columns]
    prediction = F.when(F.col("reason").isNull(), F.col("prediction_0"))
    return scored.select(*kept, prediction.alias("final_prediction"), "reason")


def score_models(requests: DataFrame, spec: CountSpec, models: Mapping[str, PipelineModel]) -> DataFrame:
    """The results of several models stacked: one row per request and model."""
    scored, columns = apply_models(valid_requests(requests, spec), spec, models)
    return stack_predictions(scored, columns)


def stack_predictions(scored: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per model instead of one column per model, from the same single pass."""
    kept = [c for c in scored.columns if c not in columns.values()]
    per_model = F.array(
        *(
            F.struct(F.lit(name).alias("model"), F.col(column).alias("final_prediction"))
            for name, column in columns.items()
        )
    )
    return scored.select(*kept, F.inline(per_model))


def reply(scored: DataFrame, spec: CountSpec) -> DataFrame:
    """The answer table: request number, inputs, and the prediction to two decimals."""
    keys = [c for c in ("request_id",) if c in scored.columns]
    reason = [c for c in ("reason",) if c in scored.columns]
    return scored.select(
        *keys, *spec.dims, two_decimals(F.col("final_prediction")).alias("predicted_headcount"), *reason
    )


def in_request_order(requests: DataFrame) -> DataFrame:
    """Requests sorted by number, for answers in that order.

    Scoring keeps the order of its input. Sorting the requests instead of the answers
    spares a second scoring: a distributed sort evaluates its input twice, first to sample
    the range boundaries.
    """
    return requests.orderBy("request_id")


class Predictor:
    """Fitted models by name with a default: the library form of a prediction service."""

    def __init__(self, spec: CountSpec, models: Mapping[str, PipelineModel], best: str):
        self.spec = spec
        self.models = models
        self.best = best

    def choose(self, model_name: str | None = None) -> str:
        chosen = model_name or self.best
        if chosen not in self.models:
            raise ValueError(f"unknown model {chosen!r}; available: {list(self.models)}")
        return chosen

    def predict(self, spark: SparkSession, request: Mapping[str, str], model_name: str | None = None) -> DataFrame:
        """One request: ``(model, predicted_headcount)``. Same path as a table of one row."""
        chosen = self.choose(model_name)
        replies = self.predict_table(requests_from_rows(spark, [request], self.spec), chosen)
        return replies.select(F.lit(chosen).alias("model"), "predicted_headcount")

    def predict_rows(
        self, spark: SparkSession, rows: Iterable[Mapping[str, str]], model_name: str | None = None
    ) -> DataFrame:
        """A short list of requests, answered in list order."""
        table = in_request_order(requests_from_rows(spark, rows, self.spec))
        return self.predict_table(table, model_name)

    def predict_table(self, requests: DataFrame, model_name: str | None = None) -> DataFrame:
        """A request table of any size; lazy. An empty table gives an empty answer even
        under an unknown model name, which otherwise is an error."""
        chosen = model_name or self.best
        if chosen not in self.models and requests.isEmpty():
            empty = requests.withColumn("final_prediction", F.lit(None).cast("double"))
            return reply(empty, self.spec)
        model = self.models[self.choose(chosen)]
        return reply(score(requests, self.spec, model), self.spec)

    def answer_table(self, requests: DataFrame, model_name: str | None = None) -> DataFrame:
        """As ``predict_table``, but every request comes back: with a prediction or a reason."""
        return reply(answered(requests, self.spec, self.models[self.choose(model_name)]), self.spec)


def unknown_models(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested model names (column ``model``) that the registry does not list."""
    return names.join(registry.select("model"), "model", "left_anti")
