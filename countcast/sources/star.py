"""The headcount fact table, derived from the order star schema.

One order line is one counted unit. The joins are plain inner equi-joins: Catalyst
broadcasts what its size statistics prove small (nation, region, at small scale the
rest), sort-merges what is not, and splits hot join keys at run time (AQE skew join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.functions import fiscal_year
from countcast.spec import CELLS, HEADCOUNT

# Four dimensions travel through joins and groupings as numbers or flags, which are half
# the size of their names or less, and are named afterwards.
COMPACT = {"fiscal_year": "_year", "term_type": "_term", "coop_regular": "_coop", "work_term": "_work"}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _compact_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per order line with its twelve dimensions, four of them compact."""
    customers = (
        table(spark, path, "customer")
        .join(table(spark, path, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("campus"), F.col("c_mktsegment").alias("visa_status"))
    )
    month = F.month("o_orderdate")
    orders = (
        table(spark, path, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            (F.year("o_orderdate") - F.when(month < 5, 1).otherwise(0)).alias("_year"),
            F.when(month < 5, 1).when(month < 9, 2).otherwise(3).alias("_term"),
            F.col("o_orderpriority").alias("study_year"),
            F.col("o_orderstatus").alias("attendance"),
            "campus",
            "visa_status",
        )
    )
    lines = table(spark, path, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_linestatus").alias("career"),
        F.col("l_returnflag").alias("program_level"),
        F.when(F.col("l_discount") >= 0.05, True).otherwise(False).alias("_coop"),
        F.when(F.col("l_tax") >= 0.04, True).otherwise(False).alias("_work"),
    )
    parts = table(spark, path, "part").select(
        "p_partkey", F.col("p_type").alias("faculty_group"), F.col("p_brand").alias("program_grouping")
    )
    # Part first: both shuffles of the lines then carry few columns, and the many order
    # columns travel once per order.
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )


def _named(dim: str) -> Column:
    """A dimension's name from its compact form; different forms have different names."""
    if dim == "fiscal_year":
        name = fiscal_year(F.col("_year"))
    elif dim == "term_type":
        name = F.when(F.col("_term") == 1, "Winter term").when(F.col("_term") == 2, "Spring term").otherwise("Fall term")
    elif dim == "coop_regular":
        name = F.when(F.col("_coop"), "Co-op").otherwise("Regular")
    elif dim == "work_term":
        name = F.when(F.col("_work"), "Work Term").otherwise("Academic Term")
    else:
        name = F.col(dim)
    return name.alias(dim)


def order_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per order line: the twelve dimensions and ``headcount`` = 1.

    Callers select what they need; unused columns never leave the scans.
    """
    lines = _compact_lines(spark, path)
    return lines.select(*map(_named, HEADCOUNT.dims), F.lit(1).cast("long").alias("headcount"))


def headcount(spark: SparkSession, path: str, dims: Sequence[str] = HEADCOUNT.dims) -> DataFrame:
    """The fact table: one row per combination of ``dims`` with its count of lines."""
    grouped = _compact_lines(spark, path).groupBy(*(COMPACT.get(d, d) for d in dims))
    return grouped.agg(F.count("*").alias("headcount")).select(*map(_named, dims), "headcount")


def cells(spark: SparkSession, path: str, counted: DataFrame | None = None) -> DataFrame:
    """The training grain, with a second, right-skewed count to learn from.

    ``counted`` is a fact table of a finer grain that is stored already: its counts are then
    summed, and the lines are not joined once more.
    """
    kind = F.col("faculty_group")
    status = F.col("attendance")
    weight = (
        F.when(kind == "PROMO", 8).when(kind == "LARGE", 4).when(kind == "SMALL", 2).otherwise(1)
        * F.when(status == "F", 5).when(status == "O", 2).otherwise(1)
    )
    if counted is None:
        counted = headcount(spark, path, CELLS.dims)
    else:
        counted = counted.groupBy(*CELLS.dims).agg(F.sum("headcount").alias("headcount"))
    return counted.withColumn("weighted_headcount", (F.col("headcount") * weight).cast("long"))
