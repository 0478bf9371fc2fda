"""What-if runs: score every combination of the selected values and summarise."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.functions import mean_of_cents, to_cents
from countcast.operators.grid import scenario_grid
from countcast.operators.option_tables import RankedOptions
from countcast.operators.rollup import rollup_dimensions
from countcast.plans.score import apply_models
from countcast.spec import MAX_COMBINATIONS, SUMMARY_DIMS, CountSpec


def mean_by(scored: DataFrame, dim: str, prediction: str = "final_prediction") -> DataFrame:
    """Mean of the two-decimal predictions per value, to two decimals, sorted by value."""
    return (
        scored.groupBy(F.col(dim).alias("name"))
        .agg(mean_of_cents(F.sum(to_cents(F.col(prediction))), F.count("*")).alias("headcount"))
        .orderBy("name")
    )


def mean_by_dimensions(
    scored: DataFrame,
    spec: CountSpec,
    dims: Sequence[str] | None = None,
    predictions: Mapping[str, str] | None = None,
    grand_total: bool = False,
) -> DataFrame:
    """``(model, dimension, value, headcount)`` for several dimensions and models.

    One pass: each prediction column becomes a sum of whole hundredths next to one row
    count. ``grand_total`` adds each model's overall mean with a null dimension.
    """
    predictions = predictions or {"model": "final_prediction"}
    dims = dims or [d for d in SUMMARY_DIMS if d in spec.dims]
    measures = {f"_cents_{i}": to_cents(F.col(c)) for i, c in enumerate(predictions.values())}
    measures["_rows"] = F.lit(1).cast("long")
    sums = rollup_dimensions(scored, dims, measures, grand_total)
    per_model = F.array(
        *(
            F.struct(
                F.lit(name).alias("model"),
                mean_of_cents(F.col(f"_cents_{i}"), F.col("_rows")).alias("headcount"),
            )
            for i, name in enumerate(predictions)
        )
    )
    return sums.select("dimension", "value", F.inline(per_model)).select(
        "model", "dimension", "value", "headcount"
    )


def compare_models(scored: DataFrame, predictions: Mapping[str, str]) -> DataFrame:
    """``(model, headcount)``: each model's mean over the same rows; zero without rows."""
    sums = scored.agg(
        F.count("*").alias("rows"),
        *(F.sum(to_cents(F.col(c))).alias(f"cents_{i}") for i, c in enumerate(predictions.values())),
    )
    per_model = F.array(
        *(
            F.struct(
                F.lit(name).alias("model"),
                F.when(F.col("rows") > 0, mean_of_cents(F.col(f"cents_{i}"), F.col("rows")))
                .otherwise(0.0)
                .alias("headcount"),
            )
            for i, name in enumerate(predictions)
        )
    )
    return sums.select(F.inline(per_model))


def check_values(lists: Mapping[str, Sequence[str]], spec: CountSpec) -> None:
    """Refuse lists with missing values or malformed years.

    Checking the few list values here spares a filter over every combination.
    """
    for dim, values in lists.items():
        if any(v is None for v in values):
            raise ValueError(f"missing value for {dim}")
    for year in lists.get(spec.year_dim, ()) if spec.year_dim else ():
        if not re.match("[0-9]{4}", year):  # what `numeric_year` reads
            raise ValueError(f"malformed year {year!r}")


def what_if(
    spark: SparkSession,
    lists: Mapping[str, Sequence[str]],
    spec: CountSpec,
    models: Mapping[str, PipelineModel],
    best: str,
    limit: int | None = MAX_COMBINATIONS,
) -> DataFrame:
    """The grid's means by dimension for the best model, and overall for every model.

    ``(model, dimension, value, headcount)``; rows with a null dimension compare the
    models. Grid, scoring by all models and every summary are one job with one shuffle
    of a few rows per task; the grid itself is never stored.
    """
    check_values(lists, spec)
    return _report(scenario_grid(spark, lists, limit), spec, models, best)


def what_if_tables(
    ranked: RankedOptions, models: Mapping[str, PipelineModel], best: str, limit: int | None = MAX_COMBINATIONS
) -> DataFrame:
    """As ``what_if``, for selections kept as tables: no option is in the plan or on the driver."""
    fault = ranked.faulty().first()
    if fault:
        raise ValueError(fault["reason"])
    return _report(ranked.grid(limit), ranked.spec, models, best)


def _report(grid: DataFrame, spec: CountSpec, models: Mapping[str, PipelineModel], best: str) -> DataFrame:
    scored, columns = apply_models(grid, spec, models)
    means = mean_by_dimensions(scored, spec, predictions=columns, grand_total=True)
    return means.filter((F.col("model") == best) | F.col("dimension").isNull())
