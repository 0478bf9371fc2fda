"""Scenario grids: every combination of the selected values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.spec import MAX_COMBINATIONS

ROWS_PER_PARTITION = 100_000


def combination_count(lists: Mapping[str, Sequence[str]]) -> int:
    """Size of the grid, without building it."""
    return prod(len(values) for values in lists.values())


def check_combinations(lists: Mapping[str, Sequence[str]], limit: int | None = MAX_COMBINATIONS) -> int:
    """The grid's size, or an error if it exceeds ``limit`` (``None`` lifts the limit)."""
    size = combination_count(lists)
    if limit is not None and size > limit:
        raise ValueError(f"too many combinations ({size:,}); reduce the selections to at most {limit:,}")
    if size >= 2**63:
        raise ValueError(f"{size:,} combinations do not fit a 64-bit request id")
    return size


def scenario_grid(
    spark: SparkSession, lists: Mapping[str, Sequence[str]], limit: int | None = MAX_COMBINATIONS
) -> DataFrame:
    """All combinations as requests, the last dimension varying fastest.

    Row ``request_id`` holds the mixed-radix digits of its own number, so the grid is a
    range scan with a projection: no join, no shuffle, and as many partitions as its size
    asks for, where chained cross joins would multiply their partition counts.
    """
    size = check_combinations(lists, limit)
    wanted = max(ceil(size / ROWS_PER_PARTITION), min(spark.sparkContext.defaultParallelism, size), 1)
    grid = spark.range(size, numPartitions=wanted).withColumnRenamed("id", "request_id")
    columns, stride = [], size
    for dim, values in lists.items():
        radix = max(len(values), 1)
        stride //= radix
        digit = F.expr(f"request_id div {max(stride, 1)} % {radix}")
        options = F.array(*(F.lit(v) for v in values)).cast("array<string>")
        columns.append(F.element_at(options, (digit + 1).cast("int")).alias(dim))
    return grid.select("request_id", *columns)
