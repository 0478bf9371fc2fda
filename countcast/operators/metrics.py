"""Prediction quality on the original count scale."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(scored: DataFrame, predictions: Mapping[str, str], label: str = "original_label") -> DataFrame:
    """``(model, rmse, r2, mae)`` for several prediction columns of one frame, in one pass.

    ``predictions`` maps model names to columns. Only one row per task is shuffled.
    """
    y = F.col(label)
    sums = []
    for i, column in enumerate(predictions.values()):
        error = y - F.col(column)
        sums += [F.avg(error * error).alias(f"mse_{i}"), F.avg(F.abs(error)).alias(f"mae_{i}")]
    one_row = scored.agg(F.var_pop(y).alias("variance"), *sums)
    per_model = F.array(
        *(
            F.struct(
                F.lit(name).alias("model"),
                F.sqrt(f"mse_{i}").alias("rmse"),
                # A constant label has no variance to explain: r2 is null, not an error.
                F.when(F.col("variance") > 0, 1 - F.col(f"mse_{i}") / F.col("variance")).alias("r2"),
                F.col(f"mae_{i}").alias("mae"),
            )
            for i, name in enumerate(predictions)
        )
    )
    return one_row.select(F.inline(per_model))


def _rank() -> Column:
    """R2, then the name; a model whose R2 is no number ranks below all others."""
    return F.struct(F.when(~F.isnan("r2"), F.col("r2")).alias("r2"), F.col("model"))


def with_best(metrics: DataFrame) -> DataFrame:
    """Flags the model with the highest R2; the name breaks ties. One row per model."""
    gathered = metrics.agg(
        F.collect_list(F.struct(*metrics.columns)).alias("rows"),
        F.max_by("model", _rank()).alias("best"),
    )
    flagged = F.transform("rows", lambda r: r.withField("is_best", r["model"] == F.col("best")))
    return gathered.select(F.inline(flagged))


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max_by("model", _rank()).alias("model"))


def calibration(stacked: DataFrame, width: float, label: str = "original_label") -> DataFrame:
    """Predictions against actuals in bins of the prediction, ``width`` counts wide.

    ``(model, bin, rows, mean_predicted, mean_actual)``: the plot of any test set in a few
    rows, with bin 0 starting at zero.
    """
    return stacked.groupBy(
        "model", F.floor(F.col("final_prediction") / width).cast("long").alias("bin")
    ).agg(
        F.count("*").alias("rows"),
        F.avg("final_prediction").alias("mean_predicted"),
        F.avg(label).alias("mean_actual"),
    )
