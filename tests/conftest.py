from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("countcast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Twelve rows with ties, a zero count, a null and a single-valued dimension."""
    rows = [
        ("2019/20", "Fall term", "ENG", "Main", 10),
        ("2019/20", "Winter term", "ENG", "Main", 0),
        ("2019/20", "Spring term", "MATH", "Main", 7),
        ("2020/21", "Fall term", "ENG", "Main", 12),
        ("2020/21", "Winter term", "ARTS", "Main", 5),
        ("2020/21", "Spring term", "MATH", "Main", 5),
        ("2021/22", "Fall term", "ARTS", "Main", 22),
        ("2021/22", "Winter term", "ENG", "Main", 3),
        ("2021/22", "Fall term", "MATH", "Main", 9),
        ("2022/23", "Winter term", None, "Main", 4),
        ("2022/23", "Fall term", "ENG", "Main", 16),
        ("2022/23", "Spring term", "ARTS", "Main", None),
    ]
    schema = "fiscal_year string, term_type string, faculty_group string, campus string, headcount bigint"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def spec():
    from countcast import CountSpec

    return CountSpec(("fiscal_year", "term_type", "faculty_group", "campus"))


@pytest.fixture(scope="session")
def tuned(spark):
    """All three models tuned on the medium table; shared by the tests that score."""
    from countcast.queries.models import tuned_run

    return tuned_run(spark, MEDIUM)
