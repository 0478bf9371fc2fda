"""Permutation importance, faulty lines, repeated requests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from countcast import CountSpec
from countcast.plans.importance import permutation_importance, with_permutations
from countcast.queries.models import BOOSTED_DIMS, closed_form_run
from countcast.plans import train
from countcast.sources.facts import quarantine_facts, read_checked_facts
from countcast.spec import CELLS
from countcast.streaming import request_stream, unique_requests
from tests.conftest import SMALL

FACTS = CountSpec(("fiscal_year", "campus"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_feature_is_dealt_anew_and_nothing_else_changes(spark):
    spec = CountSpec(("k", "v", "w"), year_dim=None)
    table = spark.createDataFrame([(str(i), f"v{i}", f"w{i}", float(i)) for i in range(200)], "k string, v string, w string, y double")
    found = {}
    for layout in (table, table.repartition(7)):
        variants = with_permutations(layout, spec, ["k"], ["v", "w"], 5).collect()
        for feature, other in (("v", "w"), ("w", "v")):
            part = [r for r in variants if r.feature == feature]
            assert sorted(r[feature] for r in part) == sorted(f"{feature}{i}" for i in range(200))
            assert all(r[other] == other + r.k for r in part) and sum(r[feature] != feature + r.k for r in part) > 180
            dealt = {r.k: r[feature] for r in part}
            assert found.setdefault(feature, dealt) == dealt
        assert len([r for r in variants if r.feature is None and r.v == f"v{r.k}"]) == 200
    other_seed = {r.k: r.v for r in with_permutations(table, spec, ["k"], ["v"], 6).collect() if r.feature == "v"}
    assert other_seed != found["v"]


def test_features_a_model_does_not_use_have_no_importance(spark):
    run = closed_form_run(spark, SMALL)
    found = {(r.model, r.feature): r for r in permutation_importance(run.test, CELLS, run.models).collect()}
    assert len(found) == 3 * len(CELLS.dims)
    for (model, feature), r in found.items():
        if model == train.BOOSTED:
            assert (abs(r.importance) < 1e-9) == (feature not in BOOSTED_DIMS)
    assert found[train.BOOSTED, "faculty_group"].importance > 1


@pytest.fixture
def lines(tmp_path):
    text = 'fiscal_year,campus,headcount\n2019/20,Main,10\n2019/20,"North, old",7\n\n2020/21,Main,ten\n2020/21,Main\n2020/21,Main,5,6\n'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("fiscal_year,campus,headcount\n2021/22,,\n,Main,99999999999999999999\n2021/22,Main, 4\n2021/22,Main,-3\n")
    return str(tmp_path)


def test_every_line_is_good_or_faulty(spark, lines):
    good, faulty = read_checked_facts(spark, lines, FACTS)
    assert rows(good) == sorted([("2019/20", "Main", 10), ("2019/20", "North, old", 7), ("2021/22", None, None), ("2021/22", "Main", -3)], key=repr)
    found = [(r.file.rsplit("/", 1)[1], r.reason, r.line) for r in faulty.collect()]
    assert sorted(f[:2] for f in found) == sorted(
        [("a.csv", "headcount is no whole number"), ("a.csv", "malformed line"), ("a.csv", "malformed line"), ("b.csv", "headcount is no whole number"), ("b.csv", "headcount is no whole number")]
    )
    assert ("a.csv", "malformed line", "2020/21,Main") in found and ("a.csv", "malformed line", "2020/21,Main,5,6") in found
    assert good.select("campus").count() == 4 and faulty.select("reason").count() == 5  # whatever columns are asked for


def test_faulty_json_and_renamed_headers(spark, tmp_path):
    good_line = {"Fiscal Year": "2019/20", "Campus": "Main", "Student Headcounts": 12}
    texts = [json.dumps(good_line), json.dumps(good_line | {"Student Headcounts": "many"}), '{"Fiscal Year": "2019/20", ', json.dumps(good_line | {"Student Headcounts": 1.5})]
    (tmp_path / "in.json").write_text("\n".join(texts))
    headers = {"Fiscal Year": "fiscal_year", "Campus": "campus", "Student Headcounts": "headcount"}
    target = str(tmp_path / "faulty")
    good = quarantine_facts(spark, str(tmp_path / "in.json"), FACTS, target, "json", headers)
    assert rows(good) == [("2019/20", "Main", 12)]
    assert sorted(r.reason for r in spark.read.parquet(target).collect()) == ["headcount is no whole number"] * 2 + ["malformed line"]
    with pytest.raises(ValueError, match="read_facts"):
        read_checked_facts(spark, "x", FACTS, "parquet")


def test_requests_seen_before_are_left_out_across_restarts(spark, tmp_path):
    spec = CountSpec(("d",), year_dim=None)
    inbox, output, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    start = datetime(2024, 1, 1)

    def send(*numbers, minutes=0):
        data = [(n, f"v{n}", start + timedelta(minutes=minutes)) for n in numbers]
        spark.createDataFrame(data, "request_id bigint, d string, sent_at timestamp").write.mode("append").parquet(inbox)

    def drain():
        once = unique_requests(request_stream(spark, inbox, spec, timed=True), within="1 hour")
        once.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(output).awaitTermination()

    send(1, 2, 2, 3)
    drain()
    send(2, 3, 4, minutes=30)
    drain()
    drain()
    assert sorted(r.request_id for r in spark.read.parquet(output).collect()) == [1, 2, 3, 4]
    send(9, minutes=600)
    drain()
    send(10, 9, minutes=601)
    drain()
    assert sorted(r.request_id for r in spark.read.parquet(output).collect()) == [1, 2, 3, 4, 9, 10]
    assert spark.read.parquet(output).where(F.col("sent_at").isNull()).isEmpty()
