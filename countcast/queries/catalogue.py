"""The register of queries, and the SQL text of the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

INPUTS = """
headcount as (
  select concat(cast(fy as varchar), '/', lpad(cast((fy + 1) % 100 as varchar), 2, '0')) as fiscal_year,
         term_type, l_linestatus as career, l_returnflag as program_level, o_orderpriority as study_year,
         r_name as campus, p_type as faculty_group, p_brand as program_grouping,
         case when l_discount >= 0.05 then 'Co-op' else 'Regular' end as coop_regular,
         case when l_tax >= 0.04 then 'Work Term' else 'Academic Term' end as work_term,
         o_orderstatus as attendance, c_mktsegment as visa_status,
         cast(count(*) as bigint) as headcount
  from (select *, year(o_orderdate) - (case when month(o_orderdate) < 5 then 1 else 0 end) as fy,
               case when month(o_orderdate) < 5 then 'Winter term'
                    when month(o_orderdate) < 9 then 'Spring term' else 'Fall term' end as term_type
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
             join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey) t
  group by all
),
cells as (
  select fiscal_year, term_type, campus, faculty_group, attendance,
         cast(sum(headcount) as bigint) as headcount,
         cast(sum(headcount * (case faculty_group when 'PROMO' then 8 when 'LARGE' then 4 when 'SMALL' then 2 else 1 end)
                  * (case attendance when 'F' then 5 when 'O' then 2 else 1 end)) as bigint) as weighted_headcount
  from headcount group by 1, 2, 3, 4, 5
)"""


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use ``headcount``, ``cells`` and the given ``ctes``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            more = f",{ctes}" if ctes else ""
            SQL[name] = f"with {INPUTS.strip()}{more}\n{sql.strip()}"
        return fn

    return register


def round6(*names: str) -> list[Column]:
    """Floating results to six decimals: the last bits depend on the order of summation."""
    return [F.round(n, 6).alias(n) for n in names]


def unpivot_sql(source: str, dims, columns: str = "") -> str:
    """``(dimension, value)`` rows of all dimensions, as a union."""
    extra = f", {columns}" if columns else ""
    return " union all ".join(
        f"select '{d}' as dimension, cast({d} as varchar) as value{extra} from {source}" for d in dims
    )
