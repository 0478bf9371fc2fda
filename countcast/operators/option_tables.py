"""Scenario selections and grids as tables, for options too many to be listed on the driver.

``options`` and ``grid`` hold a scenario's values in Python lists, which become literals of the plan.
Here a selection stays a table from the catalogue to the grid: its values are ranked within
their dimension, and each request joins the digits of its own number with the ranks. The
driver sees one count for each dimension and no value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, log10, prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.operators.grid import ROWS_PER_PARTITION
from countcast.operators.numbering import numbered
from countcast.spec import MAX_COMBINATIONS, CountSpec
from countcast.workspace import scratch_path, stored

#: A selection: dimension, value, and the place that a user gave the value (null: by value).
SELECTION = "dimension string, value string, position bigint"

#: A dimension of more options than this gives the rows of a grid, unless each of them would come
#: more than MOST_REPEATS times: a row's repeats are an array in its task.
MANY_OPTIONS, MOST_REPEATS = 100_000, 100_000


def resolved(catalogue: DataFrame, spec: CountSpec, chosen: DataFrame | None = None, cleared: Sequence[str] = ()) -> DataFrame:
    """A full selection ``(dimension, value, position)``: the chosen values of dimensions that have
    any, the first option of cleared ones, all options of the others."""
    spark = catalogue.sparkSession
    chosen = spark.createDataFrame([], SELECTION) if chosen is None else chosen
    if "position" not in chosen.columns:
        chosen = chosen.withColumn("position", F.lit(None).cast("bigint"))
    chosen = chosen.where(F.col("dimension").isin(list(spec.dims)) & F.col("value").isNotNull())
    given = chosen.select("dimension").distinct()
    offered = catalogue.where(F.col("dimension").isin(list(spec.dims))).join(given, "dimension", "left_anti")
    first = F.col("dimension").isin(list(cleared))
    open_options = offered.where(~first).select("dimension", "value")
    firsts = offered.where(first).groupBy("dimension").agg(F.min("value").alias("value"))
    places = F.lit(None).cast("bigint").alias("position")
    others = open_options.unionByName(firsts).select("dimension", "value", places)
    return others.unionByName(chosen.select("dimension", "value", "position"))


class RankedOptions:
    """Options numbered within their dimension, stored apart for each dimension.

    A folder of its own for each dimension tells the planner how large its options are, so
    that it broadcasts small ones and shuffles the others.
    """

    def __init__(self, selection: DataFrame, spec: CountSpec) -> None:
        self.spec = spec
        self.spark: SparkSession = selection.sparkSession
        if "position" not in selection.columns:
            selection = selection.withColumn("position", F.lit(None).cast("bigint"))
        once = selection.groupBy("dimension", "value").agg(F.min("position").alias("position"))
        placed = stored(numbered(once, ["dimension", F.asc_nulls_last("position"), "value"], "place"), "placed")
        # a dimension of very many options would be one task in a join of large tables
        first = self.spark.createDataFrame(placed.groupBy("dimension").agg(F.min("place").alias("first")).collect(), "dimension string, first bigint")  # a row a dimension
        ranked = placed.join(F.broadcast(first), "dimension").withColumn("rank", F.col("place") - F.col("first"))
        self._path = scratch_path(self.spark, "options")
        folder = F.array_position(F.array(*map(F.lit, spec.dims)), F.col("dimension")).alias("folder") if spec.dims else F.lit(0).alias("folder")
        ranked.select(folder, "dimension", "rank", "value").where("folder > 0").write.partitionBy("folder").parquet(self._path)
        counted = self.table().groupBy("dimension").agg(F.count("*").alias("n")).collect()  # a row a dimension
        self.counts: Mapping[str, int] = {d: 0 for d in spec.dims} | {r["dimension"]: r["n"] for r in counted}

    def table(self) -> DataFrame:
        """``(dimension, rank, value)``."""
        return self.spark.read.schema("dimension string, rank bigint, value string").parquet(self._path)

    def of(self, dim: str) -> DataFrame:
        """``(rank, value)``. The folder is read by its path: its size is then that of this dimension."""
        if not self.counts[dim]:
            return self.spark.createDataFrame([], "rank bigint, value string")
        return self.spark.read.schema("rank bigint, value string").parquet(f"{self._path}/folder={self.spec.dims.index(dim) + 1}")

    def combinations(self) -> int:
        """The exact size of the grid, from the counts alone."""
        return prod(self.counts.values())

    def size(self) -> DataFrame:
        """``(combinations, log10_combinations, refused)``; the logarithm is null for an empty grid."""
        n = self.combinations()
        logs = sum(log10(c) for c in self.counts.values()) if n else None
        return self.spark.createDataFrame([(str(n), logs, n > MAX_COMBINATIONS)], "combinations string, log10_combinations double, refused boolean")

    def check(self, limit: int | None = MAX_COMBINATIONS) -> int:
        """The size, or an error if there are more combinations than ``limit`` or than request numbers."""
        n = self.combinations()
        if limit is not None and n > limit:
            raise ValueError(f"too many combinations ({n:,}); reduce the selections to at most {limit:,}")
        if n >= 2**63:
            raise ValueError(f"{n:,} combinations do not fit a 64-bit request id")
        return n

    def faulty(self) -> DataFrame:
        """Options no request may have: missing values and malformed years."""
        malformed = (F.col("dimension") == F.lit(self.spec.year_dim)) & ~F.col("value").rlike("^[0-9]{4}")
        reason = F.when(F.col("value").isNull(), F.concat(F.lit("missing value for "), F.col("dimension"))).when(malformed, F.concat(F.lit("malformed year "), F.col("value")))
        return self.table().withColumn("reason", reason).where("reason is not null")

    def grid(self, limit: int | None = MAX_COMBINATIONS) -> DataFrame:
        """All combinations as requests, the last dimension varying fastest.

        Row ``request_id`` holds the mixed-radix digits of its own number, joined with the
        ranks one dimension after the other. Digits are spread evenly, so no join key is hot.
        A list of very many options is not joined: its own rows are repeated for all combinations of
        the others, so that the rows of the grid, which are many more, need no shuffle.
        """
        size = self.check(limit)
        wanted = max(ceil(size / ROWS_PER_PARTITION), min(self.spark.sparkContext.defaultParallelism, size), 1)
        longest = max(self.spec.dims, key=self.counts.__getitem__, default=None)
        repeated = longest is not None and self.counts[longest] > MANY_OPTIONS and 0 < size <= self.counts[longest] * MOST_REPEATS
        if repeated:
            rows = self._repeated(longest, size)
        else:
            rows = self.spark.range(size, numPartitions=wanted).withColumnRenamed("id", "request_id")
        stride = size
        for i, dim in enumerate(self.spec.dims):
            radix = max(self.counts[dim], 1)
            stride //= radix
            rows = rows.withColumn(f"digit_{i}", F.expr(f"request_id div {max(stride, 1)} % {radix}"))
        # the shortest lists first: they are broadcast, and what is shuffled later stays narrow
        for i in sorted(range(len(self.spec.dims)), key=lambda i: self.counts[self.spec.dims[i]]):
            dim = self.spec.dims[i]
            if repeated and dim == longest:
                rows = rows.drop(f"digit_{i}")
                continue
            options = self.of(dim).select(F.col("rank").alias(f"rank_{i}"), F.col("value").alias(dim))
            rows = rows.join(options, F.col(f"digit_{i}") == F.col(f"rank_{i}")).drop(f"digit_{i}", f"rank_{i}")
        return rows.select("request_id", *self.spec.dims)

    def _repeated(self, dim: str, size: int) -> DataFrame:
        """``(request_id, dim)``: each option of ``dim`` at all its places in a grid of ``size`` rows,
        in the tasks that read the options, which are stored in order."""
        radix = self.counts[dim]
        stride = prod(self.counts[d] for d in self.spec.dims[self.spec.dims.index(dim) + 1 :])
        rows = self.of(dim).select("rank", F.col("value").alias(dim), F.explode(F.sequence(F.lit(0), F.lit(size // radix - 1))).alias("other"))
        request = F.expr(f"(other div {stride} * {radix}L + rank) * {stride}L + other % {stride}")
        return rows.select(request.alias("request_id"), dim)
