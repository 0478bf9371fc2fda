"""Profiling a fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.operators.rollup import by_dimension


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))


def schema_table(df: DataFrame) -> DataFrame:
    """Column names, types and nullability as rows."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, data_type string, nullable boolean"
    )


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows in key order: a top-k step, not a sort of the table."""
    return df.orderBy(*df.columns).limit(rows)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum in one row."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def describe_long(df: DataFrame, column: str) -> DataFrame:
    """The same statistics as ``(summary, value)`` rows."""
    wide = describe(df, column)
    statistics = [F.col(s).cast("double").alias(s) for s in wide.columns]
    return wide.select(*statistics).unpivot([], list(wide.columns), "summary", "value")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct values per column, null counted as a value, from one scan.

    ``(column, value)`` pairs are made distinct first, so a column with very many values
    spreads over all tasks; only the pairs per column are then counted.
    """
    pairs = by_dimension(df, columns or df.columns).distinct()
    return pairs.groupBy(F.col("dimension").alias("column")).agg(F.count("*").alias("distinct_values"))


def approx_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, lg_k: int = 12) -> DataFrame:
    """Estimated distinct values per column, null counted as a value, within about 1.6 % at the
    default ``lg_k``.

    One fixed-size sketch per column and task is shuffled, whatever the number of values.
    """
    names = list(columns or df.columns)
    estimates = [
        (
            F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), lg_k)), F.lit(0))
            + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))
        ).alias(c)
        for c in names
    ]
    return df.agg(*estimates).unpivot([], names, "column", "distinct_values")


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls, in all columns or in the given ones."""
    return df.dropna("any", subset=list(columns) if columns else None)


def bitmap_distinct_counts(df: DataFrame, numbers: Mapping[str, Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """``(*groups, dimension, distinct_values)`` of whole numbers from 0 up, exactly.

    Each task sends bitmaps of the numbers that it met, 4 KB for 32,768 of them, in place of
    a row for each number. That suits dense numbers: keys, and ranks of category indexes
    (``category_index.with_category_index``), of which a stored index serves many counts.
    Bitmaps of finer groups add up to those of coarser ones. Nulls and negative numbers do
    not count; scattered numbers are better counted by ``distinct_counts``.
    """
    entries = [
        F.struct(F.lit(name).alias("dimension"), (F.col(c) if isinstance(c, str) else c).cast("bigint").alias("number"))
        for name, c in numbers.items()
    ]
    long = df.select(*groups, F.inline(F.array(*entries))).where("number >= 0")
    # position and bucket are of numbers from 1 up
    number = F.col("number") + 1
    maps = long.groupBy(*groups, "dimension", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")
    )
    return maps.groupBy(*groups, "dimension").agg(F.sum(F.bitmap_count("bitmap")).alias("distinct_values"))
