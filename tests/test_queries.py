"""Every registered query against its SQL on DuckDB, and the shape of every plan."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, oracle_connection
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


#: Full searches of trees: minutes of fitting, and no SQL. COUNTCAST_FULL=1 runs them too.
FULL_SEARCHES = {"L3_random_forest_reference", "L4_gradient_boosted_reference", "L5_reference_settings", "L10_reference_comparison"}


@pytest.mark.parametrize("name", sorted(queries() if os.environ.get("COUNTCAST_FULL") else set(queries()) - FULL_SEARCHES))
def test_query_matches_sql(spark, oracle, name):
    assert compare(spark, oracle, SMALL, name).startswith(("equal", "rows only"))


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    result = entry(spark)
    assert result.columns == ["dimension", "value", "total", "records"]
    assert result.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in queries() if n[0] in "APFKXJW"))
def test_plans_have_no_products_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(queries()["A2_total_by_term"](spark, SMALL))
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "l_extendedprice" not in plan


def test_totals_do_not_group_by_all_dimensions(spark):
    plan = plan_of(queries()["A2_total_by_term"](spark, SMALL))
    assert "keys=[term_type" in plan and "keys=[fiscal_year" not in plan


def test_filters_reach_the_scans(spark):
    plan = plan_of(queries()["F1_allowed_rows"](spark, SMALL))
    assert "In(o_orderstatus, [F,O])" in plan or "o_orderstatus IN (F,O)" in plan.replace("#", "")
    assert "In(r_name, [ASIA,EUROPE])" in plan


def test_year_filter_skips_partitions(spark):
    plan = plan_of(queries()["S1_parquet_facts_of_two_years"](spark, SMALL))
    assert "PartitionFilters: [fiscal_year" in plan or "PartitionFilters: [isnotnull(fiscal_year" in plan


def test_top_k_is_one_step(spark):
    plan = plan_of(queries()["A5_what_top_programs"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_scoring_adds_no_shuffle(spark):
    from countcast.operators.grid import scenario_grid
    from countcast.plans.score import score_models
    from countcast.queries.models import closed_form_run
    from countcast.spec import CELLS

    lists = {d: ["1996/97", "2029/30"] if d == "fiscal_year" else ["F", "ASIA"] for d in CELLS.dims}
    scored = score_models(scenario_grid(spark, lists), CELLS, closed_form_run(spark, SMALL).models)
    assert "Exchange" not in plan_of(scored)


def test_what_if_is_one_job_with_one_shuffle(spark):
    plan = plan_of(queries()["W4_what_if_report"](spark, SMALL))
    assert plan.count("Exchange") == 1 and plan.count("Range (") == 1
