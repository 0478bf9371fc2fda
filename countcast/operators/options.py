"""The values each dimension offers, and what a user selects from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.functions import fiscal_year, start_year
from countcast.operators.rollup import by_dimension
from countcast.spec import CountSpec
from countcast.workspace import stored

Scenario = Mapping[str, Sequence[str]]

def option_catalogue(df: DataFrame, spec: CountSpec) -> DataFrame:
    """Distinct ``(dimension, value)`` of all dimensions from one scan. Null is no option.

    Rows are counted by option, not just made distinct: the planner takes a distinct below a
    minimum for needless, and then sorts all rows of all dimensions for the minimum of a string.
    """
    counted = by_dimension(df, spec.dims).filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return counted.filter("n > 0").select("dimension", "value")


def bounded_options(catalogue: DataFrame, max_options: int | None = None) -> DataFrame:
    """The catalogue as a stored table: the facts are scanned once for all its uses.

    With ``max_options``, a dimension of more options raises before any list is built from
    it; nothing is ever cut short.
    """
    options = stored(catalogue, "options")
    if max_options is None:
        return options
    sizes = options.groupBy("dimension").count().filter(F.col("count") > max_options)
    too_long = sorted(r.dimension for r in sizes.select("dimension").collect())
    if too_long:
        raise ValueError(f"more than {max_options} options in {too_long}")
    return options


def with_future_years(options: DataFrame, spec: CountSpec, years: int) -> DataFrame:
    """``bounded_options`` plus the fiscal years that follow the last one.

    No model has seen them; they are scored through the unseen bucket and the numeric year.
    """
    last = options.filter(F.col("dimension") == spec.year_dim).agg(
        F.max(start_year(F.col("value"))).alias("last")
    )
    first = F.explode(F.sequence(F.col("last") + 1, F.col("last") + years)).alias("first")
    coming = last.filter("last is not null").select(first)
    return options.unionByName(
        coming.select(F.lit(spec.year_dim).alias("dimension"), fiscal_year(F.col("first")).alias("value"))
    )


def option_lists(options: DataFrame) -> DataFrame:
    """``bounded_options`` as one sorted array per dimension."""
    return options.groupBy("dimension").agg(F.array_sort(F.collect_set("value")).alias("options"))


def search_options(catalogue: DataFrame, text: str) -> DataFrame:
    """Options containing ``text``, ignoring case; an empty text finds all."""
    return catalogue.filter(F.lower("value").contains(F.lower(F.lit(text))))


def selection_table(spark: SparkSession, scenario: Scenario) -> DataFrame:
    rows = [(d, v) for d, values in scenario.items() for v in values]
    return spark.createDataFrame(rows, "dimension string, value string")


def selection_summary(catalogue: DataFrame, selection: DataFrame) -> DataFrame:
    """How each dimension's selection reads: none, the single value, all, or a count."""
    offered = catalogue.groupBy("dimension").agg(F.count("*").alias("offered"))
    chosen = selection.groupBy("dimension").agg(
        F.count("*").alias("chosen"), F.min("value").alias("only")
    )
    n = F.coalesce("chosen", F.lit(0))
    summary = (
        F.when(n == 0, "None")
        .when(n == 1, F.col("only"))
        .when(n == F.col("offered"), "All selected")
        .otherwise(F.concat(n.cast("string"), F.lit(" selected")))
    )
    return offered.join(chosen, "dimension", "left").select("dimension", summary.alias("summary"))


def select_all(catalogue: DataFrame) -> DataFrame:
    return catalogue


def clear_selection(catalogue: DataFrame) -> DataFrame:
    """A selection is never empty: clearing keeps each dimension's first option."""
    return catalogue.groupBy("dimension").agg(F.min("value").alias("value"))


def toggle(selection: DataFrame, dimension: str, value: str) -> DataFrame:
    """Add the value, or remove it unless it is the dimension's only one."""
    flip = selection.sparkSession.createDataFrame([(dimension, value)], "dimension string, flip string")
    lists = (
        selection.unionByName(flip, allowMissingColumns=True)
        .groupBy("dimension")
        .agg(F.collect_set("value").alias("chosen"), F.max("flip").alias("flip"))
    )
    chosen, flipped = F.col("chosen"), F.col("flip")
    after = (
        F.when(flipped.isNull(), chosen)
        .when(~F.array_contains(chosen, flipped), F.array_append(chosen, flipped))
        .when(F.size(chosen) > 1, F.array_remove(chosen, flipped))
        .otherwise(chosen)
    )
    return lists.select("dimension", F.explode(after).alias("value"))


def resolve_selection(catalogue: DataFrame, scenario: Scenario) -> DataFrame:
    """A full selection: absent dimension -> all options, empty list -> the first option.

    The catalogue is evaluated once, and only for the dimensions that need it.
    """
    given = [d for d, values in scenario.items() if values]
    cleared = F.col("dimension").isin([d for d, values in scenario.items() if not values])
    # Open dimensions group by value, cleared ones as a whole: the minimum serves both.
    group = F.when(~cleared, F.col("value")).alias("_group")
    offered = (
        catalogue.filter(~F.col("dimension").isin(given))
        .groupBy("dimension", group)
        .agg(F.min("value").alias("value"))
        .drop("_group")
    )
    return offered.unionByName(selection_table(catalogue.sparkSession, scenario))


def default_scenario(catalogue: DataFrame) -> dict[str, list[str]]:
    """One value per dimension: the first option."""
    return {r.dimension: [r.value] for r in clear_selection(catalogue).collect()}


def scenario_lists(catalogue: DataFrame, spec: CountSpec, scenario: Scenario, max_options: int | None = None) -> dict[str, list[str]]:
    """The resolved selection as value lists in dimension order.

    This collects option lists, not facts; ``max_options`` refuses longer ones. Values of
    open dimensions are sorted, given ones keep their order.
    """
    open_dims = [d for d in spec.dims if not scenario.get(d)]
    needed = catalogue.filter(F.col("dimension").isin(open_dims))
    chosen = resolve_selection(bounded_options(needed, max_options), {d: v for d, v in scenario.items() if not v})
    lists: dict[str, list[str]] = {d: list(scenario.get(d) or ()) for d in spec.dims}
    for row in chosen.orderBy("dimension", "value").collect():
        lists[row.dimension].append(row.value)
    return lists
