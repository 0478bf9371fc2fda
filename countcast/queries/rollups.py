"""Filters, totals, pivots, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from countcast.functions import start_year
from countcast.operators import filters, rollup
from countcast.queries.catalogue import query, unpivot_sql
from countcast.sources.star import headcount, order_lines, table
from countcast.spec import HEADCOUNT, SUMMARY_DIMS

# Totals add up the same over order lines as over fact rows, so queries that need no row
# counts read the lines and save the twelve-column grouping of the fact table.

TERMS = ("Fall term", "Spring term", "Winter term")
CONFIG = {
    "fiscal_year": None,
    "term_type": ["Fall term", "Winter term"],
    "campus": ["ASIA", "EUROPE"],
    "attendance": ["F", "O"],
}
FILTER_SQL = """term_type in ('Fall term', 'Winter term') and campus in ('ASIA', 'EUROPE')
  and attendance in ('F', 'O')"""


def _total_sql(*dims: str) -> str:
    names = ", ".join(dims)
    return f"select {names}, cast(sum(headcount) as bigint) as total from headcount group by {names}"


def _register_total(name: str, *dims: str, by_key: bool = False) -> None:
    @query(name, _total_sql(*dims))
    def total(spark, path):
        return rollup.total_by(order_lines(spark, path), HEADCOUNT, *dims, by_key=by_key)


@query(
    "A1_total_and_records_by_career",
    "select career, cast(sum(headcount) as bigint) as total, count(*) as records from headcount group by career",
)
def total_and_records_by_career(spark, path):
    return rollup.total_by(headcount(spark, path), HEADCOUNT, "career", records=True)


_register_total("A2_total_by_faculty", "faculty_group")
_register_total("A2_total_by_term", "term_type")
_register_total("A2_total_by_coop", "coop_regular")
_register_total("A2_total_by_campus", "campus")
_register_total("A3_total_by_year", "fiscal_year", by_key=True)
_register_total("A6_where_campus", "campus")
_register_total("A7_when_term", "term_type")
_register_total("A7_when_year_and_term", "fiscal_year", "term_type", by_key=True)


def _totals(spark, path, *dims):
    """Several dimensions' totals from one pass over the lines."""
    return rollup.totals_in_one_pass(order_lines(spark, path), HEADCOUNT, dims).drop("records")


WHO = ("career", "coop_regular", "study_year")
WHAT = ("program_level", "faculty_group")


@query(
    "A4_who_totals",
    f"""select dimension, value, cast(sum(headcount) as bigint) as total
from ({unpivot_sql("headcount", WHO, "headcount")}) group by 1, 2""",
)
def who_totals(spark, path):
    return _totals(spark, path, *WHO).orderBy("dimension", F.desc("total"), "value")


@query(
    "A5_what_totals",
    f"""select dimension, value, cast(sum(headcount) as bigint) as total
from ({unpivot_sql("headcount", WHAT, "headcount")}) group by 1, 2""",
)
def what_totals(spark, path):
    return _totals(spark, path, *WHAT).orderBy("dimension", F.desc("total"), "value")


_TOP = """select program_grouping, cast(sum(headcount) as bigint) as total
from headcount group by 1 order by total desc, program_grouping limit 15"""


@query("A5_what_top_programs", _TOP)
def top_programs(spark, path):
    return rollup.top_by(order_lines(spark, path), HEADCOUNT, "program_grouping", k=15)


@query(
    "K2_top_15_campus_programs",
    """select campus, program_grouping, cast(sum(headcount) as bigint) as total
from headcount group by 1, 2 order by total desc, campus, program_grouping limit 15""",
)
def top_campus_programs(spark, path):
    return rollup.top_by(order_lines(spark, path), HEADCOUNT, "campus", "program_grouping", k=15)


@query(
    "A8_pivot_year_by_term",
    """select fiscal_year,
  cast(sum(case when term_type = 'Fall term' then headcount else 0 end) as bigint) as fall_term,
  cast(sum(case when term_type = 'Spring term' then headcount else 0 end) as bigint) as spring_term,
  cast(sum(case when term_type = 'Winter term' then headcount else 0 end) as bigint) as winter_term
from headcount group by fiscal_year""",
)
def pivot_year_by_term(spark, path):
    wide = rollup.pivot_totals(order_lines(spark, path), HEADCOUNT, "fiscal_year", "term_type", TERMS)
    return wide.withColumnsRenamed({t: t.lower().replace(" ", "_") for t in TERMS})


@query(
    "A8_pivot_all_terms",
    """select fiscal_year,
  cast(sum(case when term_type = 'Extra term' then headcount else 0 end) as bigint) as extra_term,
  cast(sum(case when term_type = 'Fall term' then headcount else 0 end) as bigint) as fall_term,
  cast(sum(case when term_type = 'Spring term' then headcount else 0 end) as bigint) as spring_term,
  cast(sum(case when term_type = 'Winter term' then headcount else 0 end) as bigint) as winter_term
from (select fiscal_year, case when campus = 'ASIA' and term_type = 'Fall term' then 'Extra term' else term_type end as term_type, headcount from headcount)
group by fiscal_year""",
)
def pivot_all_terms(spark, path):
    """The terms are those found; one campus names its own."""
    own = F.when((F.col("campus") == "ASIA") & (F.col("term_type") == "Fall term"), "Extra term").otherwise(F.col("term_type"))
    wide = rollup.pivot_totals(order_lines(spark, path).withColumn("term_type", own), HEADCOUNT, "fiscal_year", "term_type")
    return wide.withColumnsRenamed({t: t.lower().replace(" ", "_") for t in wide.columns})


@query(
    "X8_missing_to_zero",
    """select campus, cast(coalesce(sum(case when program_level = 'A' and coop_regular = 'Co-op' then headcount end), 0)
  as bigint) as total from headcount group by campus""",
)
def missing_to_zero(spark, path):
    wanted = (F.col("program_level") == "A") & (F.col("coop_regular") == "Co-op")
    return (
        order_lines(spark, path)
        .groupBy("campus")
        .agg(F.sum(F.when(wanted, F.col("headcount"))).alias("total"))
        .na.fill(0, subset=["total"])
    )


_ALL_TOTALS = f"""select dimension, value, cast(sum(headcount) as bigint) as total, count(*) as records
from ({unpivot_sql("headcount", HEADCOUNT.dims, "headcount")}) group by 1, 2"""


@query("A9_all_totals_in_one_pass", _ALL_TOTALS)
def all_totals(spark, path):
    return rollup.totals_in_one_pass(headcount(spark, path), HEADCOUNT)


@query(
    "A9_summary_totals_over_lines",
    f"""select dimension, value, cast(sum(headcount) as bigint) as total
from ({unpivot_sql("headcount", SUMMARY_DIMS, "headcount")}) group by 1, 2""",
)
def summary_totals(spark, path):
    return _totals(spark, path, *SUMMARY_DIMS)


@query(
    "K1_ordered_totals",
    "select fiscal_year, term_type, cast(sum(headcount) as bigint) as total from headcount group by 1, 2",
)
def ordered_totals(spark, path):
    totals = order_lines(spark, path).groupBy("fiscal_year", "term_type").agg(F.sum("headcount").alias("total"))
    return totals.orderBy(F.desc("total"), "fiscal_year", "term_type")


@query("F1_allowed_rows", f"select * from headcount where {FILTER_SQL}")
def allowed_rows(spark, path):
    return filters.allowed_rows(headcount(spark, path), CONFIG)


@query(
    "F1_allowed_rows_by_table",
    """select * from headcount where program_grouping in (select p_brand from part where p_size > 45)
  and term_type in ('Fall term', 'Winter term')""",
)
def allowed_rows_by_table(spark, path):
    brands = table(spark, path, "part").filter("p_size > 45").select("p_brand")
    config = {"program_grouping": brands, "term_type": ["Fall term", "Winter term"]}
    return filters.allowed_rows(headcount(spark, path), config)


@query(
    "F1_unknown_filter_values",
    """select * from (values ('coop_regular', 'Coop'), ('coop_regular', 'Regular'), ('campus', 'ASIA'),
  ('campus', 'Asia')) as wanted(dimension, value)
where not exists (select 1 from headcount where dimension = 'coop_regular' and coop_regular = value)
  and not exists (select 1 from headcount where dimension = 'campus' and campus = value)""",
)
def unknown_filter_values(spark, path):
    config = {"coop_regular": ["Coop", "Regular"], "campus": ["ASIA", "Asia"]}
    return filters.unknown_values(order_lines(spark, path), HEADCOUNT, config)


@query(
    "F2_rows_kept_of_total",
    f"select count(*) filter (where {FILTER_SQL}) as kept, count(*) as total from headcount",
)
def rows_kept(spark, path):
    return filters.kept_of_total(headcount(spark, path), CONFIG)


@query(
    "X2_start_year",
    "select o_orderkey, cast(split_part(fy, '/', 1) as integer) as start_year from "
    "(select o_orderkey, concat(cast(year(o_orderdate) as varchar), '/', "
    "right(cast(year(o_orderdate) + 1 as varchar), 2)) as fy from orders)",
)
def start_years(spark, path):
    year = F.year("o_orderdate")
    name = F.concat(year.cast("string"), F.lit("/"), F.right((year + 1).cast("string"), F.lit(2)))
    return table(spark, path, "orders").select("o_orderkey", start_year(name).alias("start_year"))
