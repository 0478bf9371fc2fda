"""First options are taken from the few options, not from all rows."""

from __future__ import annotations

from countcast.operators import options


def test_minimum_of_options_sorts_no_rows_of_the_facts(facts, spec):
    catalogue = options.option_catalogue(facts, spec)
    for chosen in (options.clear_selection(catalogue), options.resolve_selection(catalogue, {"campus": []})):
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [dimension") + plan.count("Aggregate [value") >= 2, plan
    got = {(r.dimension, r.value) for r in options.clear_selection(catalogue).collect()}
    assert got == {("fiscal_year", "2019/20"), ("term_type", "Fall term"), ("faculty_group", "ARTS"), ("campus", "Main")}
