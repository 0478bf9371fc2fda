"""Scans, profiling, option catalogue and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from countcast.functions import storage_name
from countcast.operators import options, profile
from countcast.operators.category_index import category_index, with_category_index
from countcast.operators.numbering import numbered_as_stored
from countcast.queries.catalogue import query, round6, unpivot_sql
from countcast.sources.facts import quarantine_facts, read_checked_facts, read_facts, read_requests, read_unnumbered_requests, request_table, write_facts
from countcast.sources.star import headcount, order_lines, table
from countcast.spec import CELLS, HEADCOUNT
from countcast.workspace import scratch_path

_DIMS = ", ".join(HEADCOUNT.dims)
_COLUMNS = (*HEADCOUNT.dims, "headcount")
_OPTIONS = f"select distinct dimension, value from ({unpivot_sql('headcount', HEADCOUNT.dims)})"


def _round_trip(spark, path, format, **options_):
    target = scratch_path(spark, f"facts-{format}")
    write_facts(headcount(spark, path), target, format, **options_)
    return read_facts(spark, target, HEADCOUNT, format)


@query("S1_csv_facts", "select * from headcount")
def csv_facts(spark, path):
    return _round_trip(spark, path, "csv")


@query("S1_json_facts", "select * from headcount")
def json_facts(spark, path):
    return _round_trip(spark, path, "json")


@query(
    "S1_parquet_facts_of_two_years",
    "select * from headcount where fiscal_year in ('1996/97', '1998/99')",
)
def parquet_facts(spark, path):
    """Partitioned by year: the filter below reads two folders only."""
    facts = _round_trip(spark, path, "parquet", partition_by=["fiscal_year"])
    return facts.filter(F.col("fiscal_year").isin("1996/97", "1998/99"))


# Faults planted in lines of text: a count in words, a field too many, a line cut short.
_FAULT = """case when campus = 'ASIA' and career = 'F' then 'extra' when study_year = '5-LOW' and visa_status = 'BUILDING' then 'cut'
  when attendance = 'P' and coop_regular = 'Co-op' then 'words' end"""


def _planted_lines(spark, path):
    """The fact table as CSV files, some lines of which are faulty."""
    fields = [F.when(F.expr("fault = 'words'"), "n/a").otherwise(F.col(c).cast("string")) if c == "headcount" else F.col(c) for c in _COLUMNS]
    facts = headcount(spark, path).withColumn("fault", F.expr(_FAULT))
    line = F.when(F.expr("fault = 'cut'"), F.concat_ws(",", *fields[:2])).when(F.expr("fault = 'extra'"), F.concat_ws(",", *fields, F.lit("x"))).otherwise(F.concat_ws(",", *fields))
    target = scratch_path(spark, "lines")
    facts.select(line.alias(",".join(_COLUMNS))).write.option("header", True).option("sep", "\u0001").csv(target)
    return target


@query("S1_good_lines", f"select * from headcount where {_FAULT} is null")
def good_lines(spark, path):
    return read_checked_facts(spark, _planted_lines(spark, path), HEADCOUNT)[0]


@query(
    "S1_faulty_lines",
    f"""select case when fault = 'words' then 'headcount is no whole number' else 'malformed line' end as reason,
  case when fault = 'cut' then 'line' when fault = 'extra' then 'line' else 'row' end as given, count(*) as lines
from (select {_FAULT} as fault from headcount) where fault is not null group by 1, 2""",
)
def faulty_lines(spark, path):
    """Faulty lines as the quarantine table holds them, by reason; good ones are read beside it."""
    target = scratch_path(spark, "faulty")
    quarantine_facts(spark, _planted_lines(spark, path), HEADCOUNT, target)
    given = F.when(F.col("line").startswith("{"), "row").otherwise("line")
    return spark.read.parquet(target).groupBy("reason", given.alias("given")).agg(F.count("*").alias("lines"))


REQUEST_ID_SQL = "row_number() over (order by {keys}) - 1 as request_id"


@query("S2_requests_from_files", f"select {REQUEST_ID_SQL.format(keys=_DIMS)}, {_DIMS} from headcount")
def requests_from_files(spark, path):
    target = scratch_path(spark, "requests")
    request_table(headcount(spark, path), HEADCOUNT, distinct=False).write.json(target)
    return read_requests(spark, target, HEADCOUNT)


@query("S2_requests_without_numbers", f"select {REQUEST_ID_SQL.format(keys=_DIMS)}, {_DIMS} from headcount")
def requests_without_numbers(spark, path):
    """Lines of several text files, numbered by their places."""
    target = scratch_path(spark, "requests")
    in_order = request_table(headcount(spark, path), HEADCOUNT, distinct=False).repartitionByRange(5, "request_id")
    in_order.sortWithinPartitions("request_id").drop("request_id").write.json(target)
    return read_unnumbered_requests(spark, target, HEADCOUNT)


@query("S2_stored_rows_numbered", "select count(*) as rows, count(distinct o_orderkey) as orders, count(*) - 1 as last, (count(*) * (count(*) - 1) // 2)::bigint as sum from orders")
def stored_rows_numbered(spark, path):
    """Rows of a stored table, numbered without a shuffle: every number once."""
    orders = numbered_as_stored(spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey"), "number")
    return orders.agg(
        F.countDistinct("number").alias("rows"), F.countDistinct("o_orderkey").alias("orders"),
        F.max("number").alias("last"), F.sum("number").alias("sum"),
    )


@query(
    "S4_model_folder_names",
    """select p_partkey, replace(replace(lower(concat(p_name, '-', p_type)), ' ', '_'), '-', '_') as folder
from part""",
)
def folder_names(spark, path):
    name = F.concat("p_name", F.lit("-"), "p_type")
    return table(spark, path, "part").select("p_partkey", storage_name(name).alias("folder"))


@query("S10_option_catalogue", _OPTIONS)
def option_catalogue(spark, path):
    return options.option_catalogue(order_lines(spark, path), HEADCOUNT)


@query(
    "S10_options_with_future_years",
    f"""{_OPTIONS}
union all select 'fiscal_year', concat(cast(y as varchar), '/', lpad(cast((y + 1) % 100 as varchar), 2, '0'))
from (select max(cast(split_part(fiscal_year, '/', 1) as integer)) as last from headcount), range(1, 7) r(i),
  lateral (select last + i as y)""",
)
def options_with_future_years(spark, path):
    catalogue = options.option_catalogue(order_lines(spark, path), HEADCOUNT)
    return options.with_future_years(options.bounded_options(catalogue), HEADCOUNT, 6)


@query("P1_row_count", "select count(*) as row_count from headcount")
def row_count(spark, path):
    return profile.row_count(headcount(spark, path))


@query("P2_shape", "select count(*) as row_count, cast(13 as bigint) as column_count from headcount")
def shape(spark, path):
    return profile.shape(headcount(spark, path))


_DISTINCT = f"""select dimension as "column", count(distinct value) as distinct_values
from ({unpivot_sql("headcount", _COLUMNS)}) group by 1"""


@query(
    "P3_schema_profile",
    f"""select s.position, s.name as "column", s.data_type, d.distinct_values
from (values {", ".join(f"({i}, '{c}', '{'bigint' if c == 'headcount' else 'string'}')" for i, c in enumerate(_COLUMNS, 1))})
  as s(position, name, data_type)
join (select dimension, count(distinct value) as distinct_values
      from ({unpivot_sql("headcount", _COLUMNS)}) group by 1) d on d.dimension = s.name""",
)
def schema_profile(spark, path):
    facts = headcount(spark, path)
    counts = profile.distinct_counts(facts)
    return profile.schema_table(facts).drop("nullable").join(counts, "column")


@query("P4_preview", f"select * from headcount order by {', '.join(_COLUMNS)} limit 10")
def preview(spark, path):
    return profile.preview(headcount(spark, path))


_DESCRIBE = """select count(headcount) as count, round(avg(headcount), 6) as mean,
  round(stddev_samp(headcount), 6) as stddev, min(headcount) as min, max(headcount) as max from headcount"""


@query("P5_describe", _DESCRIBE)
def describe(spark, path):
    stats = profile.describe(headcount(spark, path), "headcount")
    return stats.select("count", *round6("mean", "stddev"), "min", "max")


@query(
    "P5_describe_long",
    f"""with d as ({_DESCRIBE})
select 'count' as summary, cast(count as double) as value from d
union all select 'mean', mean from d union all select 'stddev', stddev from d
union all select 'min', cast(min as double) from d union all select 'max', cast(max as double) from d""".replace(
        "with d as", "select * from (with d as", 1
    )
    + ")",
)
def describe_long(spark, path):
    return profile.describe_long(headcount(spark, path), "headcount").select("summary", *round6("value"))


@query("P6_distinct_counts", _DISTINCT)
def distinct_counts(spark, path):
    return profile.distinct_counts(headcount(spark, path))


@query("P6_approx_distinct_counts")
def approx_distinct_counts(spark, path):
    return profile.approx_distinct_counts(headcount(spark, path))


@query(
    "P6_key_counts_from_bitmaps",
    " union all ".join(
        f"select l_returnflag, '{c}' as dimension, count(distinct {c}) as distinct_values from lineitem where {c} >= 0 group by 1"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    ),
)
def key_counts_from_bitmaps(spark, path):
    """Distinct keys of every return flag: tasks exchange bitmaps, not keys."""
    return profile.bitmap_distinct_counts(
        table(spark, path, "lineitem"), {c: c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}, ["l_returnflag"]
    )


@query(
    "P6_rank_counts_from_bitmaps",
    " union all ".join(f"select fiscal_year, '{d}' as dimension, count(distinct {d}) as distinct_values from headcount group by 1" for d in ("campus", "program_grouping")),
)
def rank_counts_from_bitmaps(spark, path):
    """Distinct labels of every year, from the ranks of a category index."""
    facts = headcount(spark, path)
    spec = HEADCOUNT.with_dims("campus", "program_grouping")
    indexed = with_category_index(facts.select("fiscal_year", *spec.dims), spec, category_index(facts, spec))
    return profile.bitmap_distinct_counts(indexed, {d: F.col(f"{d}_idx") for d in spec.dims}, ["fiscal_year"])


def _with_nulls(spark, path):
    """The fact table with nulls where ASIA, F and a count of 2 were."""
    return headcount(spark, path).withColumns(
        {
            "campus": F.nullif("campus", F.lit("ASIA")),
            "attendance": F.nullif("attendance", F.lit("F")),
            "headcount": F.nullif("headcount", F.lit(2).cast("long")),
        }
    )


@query("P7_drop_rows_with_any_null", "select * from headcount where campus <> 'ASIA' and attendance <> 'F' and headcount <> 2")
def drop_any_null(spark, path):
    return profile.drop_null_rows(_with_nulls(spark, path))


@query(
    "P7_drop_rows_with_null_target",
    """select * replace (nullif(campus, 'ASIA') as campus, nullif(attendance, 'F') as attendance)
from headcount where headcount <> 2""",
)
def drop_null_target(spark, path):
    return profile.drop_null_rows(_with_nulls(spark, path), ["headcount"])


@query(
    "P8_options_per_dimension",
    f"""select dimension, array_to_string(list_sort(list(distinct value)), ';') as options, count(distinct value) as n
from ({unpivot_sql("headcount", HEADCOUNT.dims)}) group by 1""",
)
def options_per_dimension(spark, path):
    catalogue = options.option_catalogue(order_lines(spark, path), HEADCOUNT)
    lists = options.option_lists(options.bounded_options(catalogue))
    return lists.select(
        "dimension",
        F.array_join("options", ";").alias("options"),
        F.size("options").cast("long").alias("n"),
    )


@query("P9_option_search", f"select * from ({_OPTIONS}) where contains(lower(value), lower('Er'))")
def option_search(spark, path):
    return options.search_options(options.option_catalogue(order_lines(spark, path), HEADCOUNT), "Er")


# A selection for the scenario queries: one value, several, all, none.
SELECTION = {
    "fiscal_year": ["1996/97", "1998/99", "2029/30"],
    "term_type": ["Fall term", "Spring term", "Winter term"],
    "campus": ["EUROPE"],
    "faculty_group": [],
}
_SELECTED = ", ".join(f"('{d}', '{v}')" for d, vs in SELECTION.items() for v in vs)


@query(
    "P10_selection_summary",
    f"""select o.dimension,
  case when coalesce(chosen, 0) = 0 then 'None' when chosen = 1 then single
       when chosen = offered then 'All selected' else concat(chosen, ' selected') end as summary
from (select dimension, count(*) as offered from ({_OPTIONS}) group by 1) o
left join (select dimension, count(*) as chosen, min(value) as single
           from (values {_SELECTED}) as s(dimension, value) group by 1) c on c.dimension = o.dimension""",
)
def selection_summary(spark, path):
    catalogue = options.option_catalogue(order_lines(spark, path), HEADCOUNT)
    return options.selection_summary(catalogue, options.selection_table(spark, SELECTION))


@query(
    "P11_resolved_selection",
    f"""with o as ({_OPTIONS} )
select * from (values {_SELECTED}) as s(dimension, value)
union all select dimension, min(value) from o where dimension = 'faculty_group' group by 1
union all select dimension, value from o where dimension not in ('fiscal_year', 'term_type', 'campus', 'faculty_group')""".replace(
        "with o as", "select * from (with o as", 1
    )
    + ")",
)
def resolved_selection(spark, path):
    catalogue = options.option_catalogue(order_lines(spark, path), HEADCOUNT)
    return options.resolve_selection(catalogue, SELECTION)


@query(
    "P11_toggled_selection",
    f"""select dimension, min(value) as value from ({_OPTIONS}) where dimension <> 'campus' group by 1
union all select * from (values ('campus', 'AFRICA'), ('campus', 'ASIA'))""",
)
def toggled_selection(spark, path):
    """Clear all, add a campus, then try to remove the only term: it stays."""
    first = options.clear_selection(options.option_catalogue(order_lines(spark, path), HEADCOUNT))
    added = options.toggle(first, "campus", "ASIA")
    return options.toggle(added, "term_type", "Fall term")


@query(
    "W6_default_scenario",
    f"select dimension, min(value) as value from ({unpivot_sql('cells', CELLS.dims)}) group by 1",
)
def default_scenario(spark, path):
    catalogue = options.option_catalogue(order_lines(spark, path), CELLS)
    return options.selection_table(spark, options.default_scenario(catalogue))
