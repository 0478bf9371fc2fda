"""The full searches run side by side on one table of cells."""

from __future__ import annotations

from threading import Barrier
from types import SimpleNamespace

from countcast.plans import train
from countcast.queries import tuning


def test_tree_searches_wait_for_no_other_and_share_their_cells(spark, monkeypatch):
    both, read = Barrier(2, timeout=60), []

    def fake(facts, spec, models, parallelism):
        if models[0].name != train.LINEAR:
            both.wait()
        return SimpleNamespace(name=models[0].name, fits=parallelism, facts=facts)

    monkeypatch.setattr(tuning.train, "train", fake)
    monkeypatch.setattr(tuning, "cells", lambda spark, path: read.append(path) or spark.range(3))
    monkeypatch.setattr(tuning, "_runs", {})
    monkeypatch.setattr(tuning, "_cells", {})
    runs = tuning.reference_runs(spark, "nowhere")
    assert [r.name for r in runs] == [train.LINEAR, train.FOREST, train.BOOSTED]
    assert read == ["nowhere"] and len({id(r.facts) for r in runs}) == 1
    assert all(r.fits >= train.FOLDS * len(c.grid) for r, c in zip(runs[1:], train.candidates()[1:]))
