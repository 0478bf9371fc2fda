"""Totals along dimensions.

Dimensions have few values, so partial aggregation shrinks each task's rows to a
handful before the shuffle; a value holding a third of all rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.spec import CountSpec


def total_by(
    df: DataFrame, spec: CountSpec, *dims: str, records: bool = False, by_key: bool = False
) -> DataFrame:
    """Total count per value (or value pair), largest first; keys break ties.

    ``by_key`` sorts by the keys instead (trends); ``records`` adds the number of rows.
    """
    measures = [F.sum(spec.target).alias("total")]
    if records:
        measures.append(F.count("*").alias("records"))
    totals = df.groupBy(*dims).agg(*measures)
    return totals.orderBy(*dims) if by_key else totals.orderBy(F.desc("total"), *dims)


def top_by(df: DataFrame, spec: CountSpec, *dims: str, k: int = 15) -> DataFrame:
    """The ``k`` values with the largest totals; sort and limit run as one top-k step."""
    return total_by(df, spec, *dims).limit(k)


def pivot_totals(df: DataFrame, spec: CountSpec, rows: str, columns: str, values: Sequence[str] | None = None) -> DataFrame:
    """Totals as a ``rows`` x ``columns`` table, absent combinations as zero.

    All values found become columns, in their order. ``values`` (from an option catalogue)
    spare the job that looks for them, and leave out all others.
    """
    wide = df.groupBy(rows).pivot(columns, list(values) if values is not None else None).agg(F.sum(spec.target))
    return wide.na.fill(0).orderBy(rows)


def by_dimension(df: DataFrame, dims: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``(*carry, dimension, value)``: each row once per dimension. Null values stay."""
    text = df.select(*carry, *(F.col(d).cast("string").alias(d) for d in dims))
    return text.unpivot(list(carry), list(dims), "dimension", "value")


def rollup_dimensions(
    df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column], grand_total: bool = False
) -> DataFrame:
    """Sums per value of every dimension in one pass: ``(dimension, value, *measures)``.

    The copies of a row meet a two-column hash table inside the same task, so what is
    shuffled is a few sums per task. The same totals by grouping sets carry a key of all
    dimensions at once and took more than twice as long (README). ``grand_total`` adds one
    row with null dimension and value.
    """
    inputs = df.select(*dims, *(m.alias(name) for name, m in measures.items()))
    dims, dimension = list(dims), F.col("dimension")
    if grand_total:
        inputs = inputs.withColumn("_all", F.lit(None).cast("string"))
        dims, dimension = [*dims, "_all"], F.nullif("dimension", F.lit("_all"))
    return (
        by_dimension(inputs, dims, list(measures))
        .groupBy(dimension.alias("dimension"), "value")
        .agg(*(F.sum(name).alias(name) for name in measures))
    )


def totals_in_one_pass(df: DataFrame, spec: CountSpec, dims: Sequence[str] | None = None) -> DataFrame:
    """``(dimension, value, total, records)`` for every dimension from one scan."""
    measures = {"total": F.col(spec.target), "records": F.lit(1).cast("long")}
    return rollup_dimensions(df, dims or spec.dims, measures)
