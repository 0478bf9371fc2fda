from __future__ import annotations

from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countcast.functions import numeric_year
from countcast.operators import filters, grid, metrics, options, profile, rollup
from countcast.spec import HEADCOUNT, CountSpec
from countcast.sources.star import headcount
from tests.conftest import SMALL


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_totals_are_sorted_with_keys_breaking_ties(facts, spec):
    assert rows(rollup.total_by(facts, spec, "term_type", records=True)) == [
        ("Fall term", 69, 5),
        ("Spring term", 12, 3),
        ("Winter term", 12, 4),
    ]


def test_trend_is_sorted_by_key(facts, spec):
    years = [r[0] for r in rows(rollup.total_by(facts, spec, "fiscal_year", by_key=True))]
    assert years == ["2019/20", "2020/21", "2021/22", "2022/23"]


def test_pivot_takes_all_values_found(facts, spec):
    wide = rollup.pivot_totals(facts.dropna(), spec, "fiscal_year", "term_type")
    assert wide.columns == ["fiscal_year", "Fall term", "Spring term", "Winter term"]
    assert sum(sum(r[1:]) for r in wide.collect()) == facts.dropna().groupBy().sum("headcount").first()[0]


def test_more_options_than_any_list_had(spark, spec):
    many = spark.range(100_001).selectExpr("'campus' as dimension", "cast(id as string) as value")
    assert options.option_lists(options.bounded_options(many)).selectExpr("size(options)").first()[0] == 100_001


def test_years_need_four_digits(spark):
    years = spark.createDataFrame([("2016/17",), ("NaN",), ("9e99",), ("20a6",), ("",), (None,), ("2016",)], "y string")
    assert [r.n for r in years.select(numeric_year(F.col("y")).alias("n")).collect()] == [2016.0, None, None, None, None, None, 2016.0]


def test_estimates_count_nulls_and_doubles(spark):
    df = spark.createDataFrame([(1.5, "a"), (2.5, None), (None, "a")], "x double, y string")
    assert dict(profile.approx_distinct_counts(df).collect()) == {"x": 3, "y": 2}


def test_a_model_without_a_score_is_never_best(spark):
    rows = spark.createDataFrame([("a", float("nan")), ("b", 0.1), ("c", None)], "model string, r2 double")
    assert metrics.best_model(rows).first()[0] == "b"


def test_pivot_fills_absent_combinations(facts, spec):
    wide = rollup.pivot_totals(facts, spec, "fiscal_year", "term_type", ["Fall term", "Spring term"])
    assert rows(wide) == [("2019/20", 10, 7), ("2020/21", 12, 5), ("2021/22", 31, 0), ("2022/23", 16, 0)]


def test_one_pass_equals_separate_totals_and_keeps_null_values(facts, spec):
    one_pass = {(d, v): (t, n) for d, v, t, n in rows(rollup.totals_in_one_pass(facts, spec))}
    for dim in spec.dims:
        for value, total, records in rows(rollup.total_by(facts, spec, dim, records=True)):
            assert one_pass.pop((dim, value)) == (total, records)
    assert not one_pass


def test_every_dimension_sums_to_the_grand_total(spark):
    facts = headcount(spark, SMALL)
    total = facts.agg(F.sum("headcount")).first()[0]
    sums = rollup.totals_in_one_pass(facts, HEADCOUNT).groupBy("dimension").agg(F.sum("total").alias("t"))
    assert {r.dimension: r.t for r in sums.collect()} == dict.fromkeys(HEADCOUNT.dims, total)


def test_grand_total_row(facts, spec):
    sums = rollup.rollup_dimensions(facts, ["campus"], {"n": F.lit(1)}, grand_total=True)
    assert sorted(rows(sums), key=repr) == [("campus", "Main", 12), (None, None, 12)]


def test_filters_without_lists_keep_all_and_unknown_values_are_named(facts, spec):
    assert filters.allowed_rows(facts, {"campus": None}).count() == 12
    config = {"campus": ["Maine"], "term_type": ["Fall term"]}
    assert filters.allowed_rows(facts, config).count() == 0
    assert rows(filters.kept_of_total(facts, config)) == [(0, 12)]
    assert rows(filters.unknown_values(facts, spec, config)) == [("campus", "Maine")]
    assert rows(filters.unknown_values(facts, spec, {"campus": None})) == []


def test_long_lists_and_tables_filter_like_short_lists(facts, monkeypatch):
    config = {"term_type": ["Fall term", "Spring term"], "faculty_group": ["ENG"]}
    expected = sorted(rows(filters.allowed_rows(facts, config)))
    monkeypatch.setattr(filters, "MAX_INLINE_VALUES", 0)
    assert sorted(rows(filters.allowed_rows(facts, config))) == expected
    assert rows(filters.kept_of_total(facts, config)) == [(len(expected), 12)]
    table = facts.filter("faculty_group = 'ENG'").select("faculty_group")
    assert filters.allowed_rows(facts, {"faculty_group": table}).count() == 5


def test_distinct_counts_count_null_as_a_value(facts):
    counts = dict(rows(profile.distinct_counts(facts)))
    assert counts["faculty_group"] == 4 and counts["campus"] == 1
    assert counts["headcount"] == facts.select("headcount").distinct().count()


def test_approximate_counts_are_close(spark):
    facts = headcount(spark, SMALL)
    exact = dict(rows(profile.distinct_counts(facts)))
    for column, estimate in rows(profile.approx_distinct_counts(facts)):
        assert abs(estimate - exact[column]) <= max(1, 0.05 * exact[column])


def test_describe_ignores_nulls(facts):
    assert profile.describe(facts, "headcount").first()["count"] == 11
    assert dict(rows(profile.describe_long(facts, "headcount")))["max"] == 22.0


def test_null_rows_are_dropped(facts):
    assert profile.drop_null_rows(facts).count() == 10
    assert profile.drop_null_rows(facts, ["headcount"]).count() == 11


def test_preview_and_schema(facts):
    assert len(rows(profile.preview(facts, 3))) == 3
    assert rows(profile.schema_table(facts))[-1] == (5, "headcount", "bigint", True)


def test_options_search_and_selection(facts, spec, spark):
    catalogue = options.option_catalogue(facts, spec)
    assert ("faculty_group", None) not in rows(catalogue)
    assert sorted(v for _, v in rows(options.search_options(catalogue, "TERM"))) == [
        "Fall term", "Spring term", "Winter term",
    ]
    assert options.search_options(catalogue, "").count() == catalogue.count()
    chosen = options.selection_table(spark, {"term_type": ["Fall term", "Spring term"], "campus": ["Main"]})
    assert dict(rows(options.selection_summary(catalogue, chosen))) == {
        "fiscal_year": "None", "faculty_group": "None", "term_type": "2 selected", "campus": "Main",
    }
    everything = options.selection_summary(catalogue, options.select_all(catalogue))
    assert dict(rows(everything))["term_type"] == "All selected"


def test_toggle_adds_removes_and_keeps_the_last(spark):
    start = options.selection_table(spark, {"a": ["x", "y"], "b": ["z"]})
    assert sorted(rows(options.toggle(start, "a", "w"))) == [("a", "w"), ("a", "x"), ("a", "y"), ("b", "z")]
    assert sorted(rows(options.toggle(start, "a", "x"))) == [("a", "y"), ("b", "z")]
    assert sorted(rows(options.toggle(start, "b", "z"))) == [("a", "x"), ("a", "y"), ("b", "z")]


def test_scenario_lists_resolve_and_refuse_identifiers(facts, spec):
    catalogue = options.option_catalogue(facts, spec)
    lists = options.scenario_lists(
        catalogue, spec, {"term_type": [], "fiscal_year": ["2029/30", "2019/20"]}
    )
    assert lists == {
        "fiscal_year": ["2029/30", "2019/20"],
        "term_type": ["Fall term"],
        "faculty_group": ["ARTS", "ENG", "MATH"],
        "campus": ["Main"],
    }
    assert options.default_scenario(catalogue)["faculty_group"] == ["ARTS"]
    with pytest.raises(ValueError, match="faculty_group"):
        options.scenario_lists(catalogue, spec, {}, max_options=2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5))
def test_grid_is_the_ordered_product(spark, sizes):
    lists = {f"d{i}": [f"v{i}_{j}" for j in range(n)] for i, n in enumerate(sizes)}
    built = grid.scenario_grid(spark, lists).orderBy("request_id")
    expected = list(product(*lists.values()))
    assert [tuple(r)[1:] for r in built.collect()] == expected
    assert grid.combination_count(lists) == len(expected)


def test_grid_limit(spark):
    lists = {"a": [str(i) for i in range(1000)], "b": [str(i) for i in range(101)]}
    with pytest.raises(ValueError, match="101,000"):
        grid.scenario_grid(spark, lists)
    assert grid.scenario_grid(spark, lists, limit=None).count() == 101_000
    with pytest.raises(ValueError, match="64-bit"):
        grid.check_combinations({str(i): ["x"] * 1000 for i in range(7)}, limit=None)


def test_grid_partitions_follow_its_size(spark):
    lists = {"a": [str(i) for i in range(1000)], "b": [str(i) for i in range(2000)]}
    assert grid.scenario_grid(spark, lists, limit=None).rdd.getNumPartitions() == 20


def test_spec_of_takes_all_other_columns(facts):
    assert CountSpec.of(facts, "headcount").dims == ("fiscal_year", "term_type", "faculty_group", "campus")
