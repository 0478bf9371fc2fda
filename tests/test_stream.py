from __future__ import annotations

from countcast.operators.rollup import totals_in_one_pass
from countcast.plans.score import Predictor
from countcast.sources.facts import request_table
from countcast.sources.star import cells
from countcast.spec import CELLS
from countcast.streaming import current_totals, fact_stream, request_stream, score_stream, start_scoring, start_totals, total_measures
from tests.conftest import SMALL


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_and_restarts_without_repeats(spark, tuned, tmp_path):
    inbox, output, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    requests = request_table(cells(spark, SMALL), CELLS)
    early, late = requests.filter("request_id % 2 = 0"), requests.filter("request_id % 2 = 1")
    model = tuned.models[tuned.best]

    def drain():
        stream = score_stream(request_stream(spark, inbox, CELLS, files_per_batch=2), CELLS, model)
        start_scoring(stream, output, state, once=True).awaitTermination()

    early.write.parquet(inbox)
    drain()
    late.write.mode("append").parquet(inbox)
    drain()
    drain()
    expected = Predictor(CELLS, tuned.models, tuned.best).predict_table(requests)
    assert rows(spark.read.parquet(output).select(*expected.columns)) == rows(expected)


def test_totals_follow_appended_facts_and_survive_restarts(spark, facts, spec, tmp_path):
    inbox, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    whole = facts.coalesce(1).sortWithinPartitions("fiscal_year", "term_type")
    parts = [whole.filter("fiscal_year = '2019/20'"), whole.filter("fiscal_year = '2020/21'"), whole.filter("fiscal_year > '2021'")]
    seen = None
    for part in parts:
        part.write.mode("append").parquet(inbox)
        job = start_totals(fact_stream(spark, inbox, spec), spec.dims, total_measures(spec), target, state, once=True)
        job.awaitTermination()
        seen = part if seen is None else seen.unionByName(part)
        read = sum(p["numInputRows"] for p in job.recentProgress)
        assert read == part.count()  # old facts are not read again
        found = current_totals(spark, target, ["total", "records"]).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, totals_in_one_pass(seen, spec).collect()), key=repr)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    changed = spark.read.parquet(f"{target}/batch={last}").where("dimension = 'fiscal_year'")
    assert sorted(r.value for r in changed.collect()) == ["2021/22", "2022/23"]  # only what the batch changed
