"""Queries that score take requests and training counts from one join of the lines."""

from __future__ import annotations

from datetime import date

import pytest

from countcast.queries import models, scoring
from countcast.sources import star
from countcast.spec import CELLS, HEADCOUNT

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, None)]),
    "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1), (2, None)]),
    "customer": ("c_custkey bigint, c_nationkey int, c_mktsegment string", [(1, 0, "A"), (2, 1, "B"), (2, 0, None), (None, 0, "C")]),
    "part": ("p_partkey bigint, p_type string, p_brand string", [(1, "PROMO", "x"), (2, "SMALL", "y"), (3, None, "y"), (3, "SMALL", "y")]),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderpriority string, o_orderstatus string",
        [(k, 1 + k % 2, None if k == 5 else date(1994 + k % 4, 1 + k % 12, 3), f"{k % 3}-P", "FOP"[k % 3]) for k in range(40)],
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linestatus string, l_returnflag string, l_discount double, l_tax double",
        [(n % 40, 1 + n % 3, "OF"[n % 2], None if n % 11 == 0 else "ANR"[n % 3], n % 10 / 100, n % 7 / 100) for n in range(300)],
    ),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_cells_from_stored_facts_are_those_of_the_lines(spark, folder):
    def rows(df):
        return sorted((tuple(r) for r in df.select(*CELLS.dims, "headcount", "weighted_headcount").collect()), key=repr)

    counted = scoring._facts(spark, folder)
    assert counted.columns == [*HEADCOUNT.dims, "headcount", "request_id"]
    found = rows(star.cells(spark, folder, counted))
    assert found == rows(star.cells(spark, folder)) and len(found) < counted.count()


def test_scoring_joins_the_lines_once(spark, folder, monkeypatch):
    joins, inner = [], star._compact_lines
    monkeypatch.setattr(star, "_compact_lines", lambda *a: joins.append(a) or inner(*a))
    monkeypatch.setattr(models, "_runs", {})
    monkeypatch.setattr(scoring, "_numbered_facts", {}, raising=False)
    assert scoring.empty_batch(spark, folder).isEmpty()
    assert not scoring.replies_written(spark, folder).isEmpty()
    assert len(joins) == 1
