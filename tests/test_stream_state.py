"""Numbers of requests seen are kept on disk, not in the heap of the executors."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from countcast import CountSpec
from countcast.streaming import request_stream, start_scoring, unique_requests
from countcast.streaming.requests import PROVIDER

SPEC = CountSpec(("d",), year_dim=None)


@pytest.fixture
def drain(spark, tmp_path):
    inbox, output, state = (str(tmp_path / p) for p in ("in", "out", "state"))

    def run(*numbers, through=start_scoring):
        data = [(n, None if n % 3 == 0 else f"v{n}", datetime(2024, 1, 1) + timedelta(seconds=n)) for n in numbers]
        spark.createDataFrame(data, "request_id bigint, d string, sent_at timestamp").write.mode("append").parquet(inbox)
        query = through(unique_requests(request_stream(spark, inbox, SPEC, timed=True)), output, state, once=True)
        query.awaitTermination()
        used = [s["customMetrics"] for p in query.recentProgress for s in p["stateOperators"]]
        return any(k.startswith("rocksdb") for m in used for k in m), sorted(r.request_id for r in spark.read.parquet(output).collect())

    return run


def test_state_is_on_disk_and_survives_restarts(spark, drain):
    before = spark.conf.get(PROVIDER, None)
    assert drain(1, 2, 2, 3) == (True, [1, 2, 3])
    assert drain(2, 3, 4) == (True, [1, 2, 3, 4])
    assert spark.conf.get(PROVIDER, None) == before


def test_checkpoints_in_the_heap_go_on(spark, drain):
    def as_before(replies, output, checkpoint, once):
        return replies.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)

    assert drain(1, 2, through=as_before) == (False, [1, 2])
    assert drain(2, 3) == (False, [1, 2, 3])


def test_a_provider_that_the_session_names_is_kept(spark, drain):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert drain(1, 1) == (False, [1])
    finally:
        spark.conf.unset(PROVIDER)
