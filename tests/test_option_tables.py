"""Scenario grids from tables of options, against grids from lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from countcast import CountSpec
from countcast.operators import option_tables, options
from countcast.operators.grid import scenario_grid
from countcast.plans import whatif
from countcast.queries.models import closed_form_run
from countcast.sources.star import cells
from countcast.spec import CELLS
from tests.conftest import SMALL

SPEC = CountSpec(("a", "b", "c"), year_dim=None)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def catalogue(spark):
    values = [("a", v) for v in "zyx"] + [("b", v) for v in "pq"] + [("c", str(i)) for i in range(12)] + [("other", "o")]
    return spark.createDataFrame(values, "dimension string, value string")


def ranked(spark, chosen=(), cleared=()):
    table = spark.createDataFrame(list(chosen), option_tables.SELECTION)
    return option_tables.RankedOptions(option_tables.resolved(catalogue(spark), SPEC, table, cleared), SPEC)


@pytest.mark.parametrize("scenario", [{}, {"a": ["x", "z"]}, {"b": [], "c": ["7", "1", "99"]}, {"a": ["z"], "b": ["q"], "c": []}])
def test_table_grids_equal_list_grids(spark, scenario):
    chosen = [(d, v, i) for d, values in scenario.items() for i, v in enumerate(values)]
    by_table = ranked(spark, chosen, [d for d, values in scenario.items() if not values])
    lists = options.scenario_lists(catalogue(spark), SPEC, scenario)
    assert rows(by_table.grid()) == rows(scenario_grid(spark, lists))
    assert by_table.combinations() == by_table.grid().count()


def test_repeated_null_and_foreign_choices(spark):
    chosen = [("a", "x", 1), ("a", "x", 0), ("a", None, 2), ("nowhere", "v", 0), ("b", None, 0)]
    by_table = ranked(spark, chosen)
    assert by_table.counts == {"a": 1, "b": 2, "c": 12}  # nulls choose nothing


def test_a_dimension_without_options_gives_no_row(spark):
    spec = CountSpec(("a", "missing"), year_dim=None)
    none = option_tables.RankedOptions(option_tables.resolved(catalogue(spark), spec), spec)
    assert none.combinations() == 0 and none.grid().count() == 0
    assert none.size().first() == ("0", None, False)


def test_sizes_are_exact_and_limits_hold(spark):
    wide = CountSpec(tuple(f"d{i}" for i in range(24)), year_dim=None)
    values = spark.createDataFrame([(d, str(v)) for d in wide.dims for v in range(10)], "dimension string, value string")
    huge = option_tables.RankedOptions(option_tables.resolved(values, wide), wide)
    assert huge.size().first() == (str(10**24), pytest.approx(24.0), True)
    with pytest.raises(ValueError, match="too many combinations"):
        huge.grid()
    with pytest.raises(ValueError, match="64-bit"):
        huge.grid(limit=None)


def test_no_option_is_in_the_plan(spark):
    plan = ranked(spark).grid()._jdf.queryExecution().toString()
    assert "range" in plan.lower() and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not any(f"'{v}'" in plan or f"[{v}," in plan for v in ("zyx", "z", "y", "p", "q", "11"))
    assert plan.count("BroadcastHashJoin") >= 3 and "hashpartitioning" not in plan  # short lists are broadcast


def test_long_lists_are_shuffled_and_short_ones_are_not(spark):
    long = spark.range(60_000).select(F.lit("a").alias("dimension"), F.format_string("option %08d", "id").alias("value"))
    both = long.unionByName(spark.createDataFrame([("b", "p"), ("b", "q")], "dimension string, value string"))
    spec = CountSpec(("a", "b"), year_dim=None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        grid = option_tables.RankedOptions(option_tables.resolved(both, spec), spec).grid(limit=None)
        plan = grid._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
        assert grid.agg(F.count("*"), F.countDistinct("a", "b"), F.max("request_id")).first() == (120_000, 120_000, 119_999)
        assert grid.where("request_id = 3").first()[1:] == ("option 00000001", "q")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reports_and_their_faults(spark):
    run = closed_form_run(spark, SMALL)
    offered = options.option_catalogue(cells(spark, SMALL), CELLS)
    lists = options.scenario_lists(offered, CELLS, {"campus": ["ASIA", "EUROPE"]})
    chosen = spark.createDataFrame([("campus", "ASIA", 0), ("campus", "EUROPE", 1)], option_tables.SELECTION)
    by_table = option_tables.RankedOptions(option_tables.resolved(offered, CELLS, chosen), CELLS)
    assert rows(whatif.what_if_tables(by_table, run.models, run.best)) == rows(whatif.what_if(spark, lists, CELLS, run.models, run.best))
    bad = spark.createDataFrame([("fiscal_year", "20a6", 0)], option_tables.SELECTION)
    faulty = option_tables.RankedOptions(option_tables.resolved(offered, CELLS, bad), CELLS)
    with pytest.raises(ValueError, match="malformed year 20a6"):
        whatif.what_if_tables(faulty, run.models, run.best)


@pytest.mark.parametrize("year", ["1e99", "nan", "20a6", "", "199"])
def test_years_of_scenarios_follow_the_strict_rule(year):
    with pytest.raises(ValueError, match="malformed year"):
        whatif.check_values({"fiscal_year": [year]}, CELLS)
    whatif.check_values({"fiscal_year": ["2029/30"]}, CELLS)


@pytest.mark.parametrize("scenario", [{}, {"c": ["7", "1", "99"]}, {"a": [], "b": ["q", "p"]}])
@pytest.mark.parametrize("place", range(3))
def test_grids_built_from_the_rows_of_the_longest_list(spark, monkeypatch, scenario, place):
    spec = CountSpec(("a", "b", "c")[place:] + ("a", "b", "c")[:place], year_dim=None)
    chosen = spark.createDataFrame([(d, v, i) for d, values in scenario.items() for i, v in enumerate(values)], option_tables.SELECTION)
    cleared = [d for d, values in scenario.items() if not values]
    by_table = option_tables.RankedOptions(option_tables.resolved(catalogue(spark), spec, chosen, cleared), spec)
    joined = rows(by_table.grid())
    monkeypatch.setattr(option_tables, "MANY_OPTIONS", 1)
    assert rows(by_table.grid()) == joined and len(joined) == by_table.combinations()


def test_rows_of_a_long_list_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(option_tables, "MANY_OPTIONS", 10_000)
    orders = spark.range(20_000).select(F.lit("c").alias("dimension"), F.col("id").cast("string").alias("value"))
    long = option_tables.RankedOptions(option_tables.resolved(catalogue(spark).where("dimension <> 'c'").unionByName(orders), SPEC), SPEC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the short lists are far below, the long one above
    try:
        grid = long.grid(limit=None)
        plan = grid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    found = grid.agg(F.count("*"), F.count_distinct("request_id"), F.min("request_id"), F.max("request_id"), F.count_distinct("c")).first()
    assert found == (120_000, 120_000, 0, 119_999, 20_000)
