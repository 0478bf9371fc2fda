"""Totals kept up to date as facts are appended, without reading old facts again.

A stream sums each new file's rows by dimension value; the running sums are state in the
checkpoint, a row for each value. Every batch writes the sums that it changed to a folder
of its own number, so a batch that is repeated after a fault replaces what it had written. The
last sums written for a value are its totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from countcast.functions import mean_of_cents, to_cents
from countcast.operators.rollup import rollup_dimensions
from countcast.spec import CountSpec


def fact_stream(spark: SparkSession, folder: str, spec: CountSpec, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Facts from files appended to a folder."""
    reader = spark.readStream.format(format).schema(spec.fact_schema())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def total_measures(spec: CountSpec) -> dict[str, Column]:
    """Sums behind ``totals_in_one_pass``."""
    return {"total": F.col(spec.target), "records": F.lit(1).cast("long")}


def mean_measures(prediction: str) -> dict[str, Column]:
    """Sums behind ``mean_by_dimensions``: whole hundredths, which add up exactly."""
    return {"cents": to_cents(F.col(prediction)), "rows": F.lit(1).cast("long")}


def start_totals(
    rows: DataFrame, dims: Sequence[str], measures: Mapping[str, Column], target: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep sums of ``measures`` by value of every dimension. ``once`` takes in what is there and stops."""
    sums = rollup_dimensions(rows, dims, measures)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_totals(spark: SparkSession, target: str, measures: Sequence[str]) -> DataFrame:
    """``(dimension, value, *measures)`` after the last batch: of each value, what was written last."""
    fields = [T.StructField(n, T.StringType()) for n in ("dimension", "value")] + [T.StructField(m, T.LongType()) for m in measures]
    written = spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(target)
    last = written.groupBy("dimension", "value").agg(F.max_by(F.struct(*measures), "batch").alias("last"))
    return last.select("dimension", "value", "last.*")


def current_means(spark: SparkSession, target: str) -> DataFrame:
    """``(dimension, value, headcount)``: means of two-decimal predictions, from ``mean_measures``."""
    sums = current_totals(spark, target, ["cents", "rows"])
    return sums.select("dimension", "value", mean_of_cents(F.col("cents"), F.col("rows")).alias("headcount"))
