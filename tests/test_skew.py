"""One order holds a third of the lines, and one part another third."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, oracle_connection
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in ("orders", "customer", "nation", "region", "part"):
        shutil.copy(f"{MEDIUM}/{name}.parquet", f"{folder}/{name}.parquet")
    duckdb.sql(
        f"""copy (select * replace (
              case when row_number() over () % 3 = 0 then 7 else l_orderkey end as l_orderkey,
              case when row_number() over () % 3 = 1 then 11 else l_partkey end as l_partkey)
            from '{MEDIUM}/lineitem.parquet') to '{folder}/lineitem.parquet' (row_group_size 4096)"""
    )
    return folder


SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.files.maxPartitionBytes": "128k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NAMES = ["A9_all_totals_in_one_pass", "A2_total_by_faculty", "P6_distinct_counts", "F1_allowed_rows_by_table", "U1_stacked_predictions"]


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_give_the_same_results(spark, no_broadcast, skewed, name):
    connection = duckdb.connect()
    for table in ("orders", "customer", "nation", "region", "part", "lineitem"):
        connection.execute(f"create view {table} as select * from '{skewed}/{table}.parquet'")
    assert name in oracle_sql()
    assert compare(spark, connection, skewed, name).startswith("equal")


def test_hot_join_keys_are_split(spark, no_broadcast, skewed):
    df = queries()["A9_all_totals_in_one_pass"](spark, skewed)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin(skew=true)") == 2
