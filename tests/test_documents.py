"""Published runs: whole at any moment, relative, and removed only when nothing names them."""

from __future__ import annotations

import json
import shutil
import threading

import pytest

from countcast.plans.score import apply_models
from countcast.queries.models import closed_form_run
from countcast.sources import documents
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def run(spark):
    return closed_form_run(spark, SMALL)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_published_run_is_read_back(spark, run, tmp_path):
    root = str(tmp_path / "models")
    saved = documents.save_run(run.models, run.metrics, root)
    content = json.loads((tmp_path / "models" / "metadata.json").read_text())
    assert content["best_model"] == run.best and set(content["models"]) == set(run.models)
    for entry in content["models"].values():
        assert set(entry) == {"path", "RMSE", "R2", "MAE"} and (tmp_path / entry["path"] / "metadata").is_dir()
    read = documents.read_document(spark, root)
    assert read == saved and rows(read.table(spark).drop("path")) == rows(run.metrics)
    models, best = documents.load_models(read)
    assert best == run.best
    assert rows(apply_models(run.test, run.spec, models)[0]) == rows(apply_models(run.test, run.spec, run.models)[0])
    with pytest.raises(ValueError, match="available"):
        read.load("No Such Model")
    assert read.load()[0] == run.best


def test_plain_documents_and_moved_folders(spark, run, tmp_path):
    plain = tmp_path / "models"
    for name, folder in (("Linear Regression", "linear_regression"), ("Random Forest", "random_forest")):
        run.models[name].write().save(str(plain / folder))
    figures = {"RMSE": 1.5, "R2": 0.5, "MAE": 1.0}
    entries = {"Linear Regression": {"path": "models/linear_regression", **figures}, "Random Forest": {"path": "models/random_forest", **figures}}
    (plain / "metadata.json").write_text(json.dumps({"best_model": "Random Forest", "models": entries}))
    for root in (plain, tmp_path / "elsewhere" / "renamed"):
        if root != plain:
            shutil.copytree(plain, root)
            shutil.copytree(plain, tmp_path / "kept")
        models, best = documents.load_models(documents.read_document(spark, str(root)))
        assert set(models) == set(entries) and best == "Random Forest"
    with pytest.raises(FileNotFoundError):
        documents.read_document(spark, str(tmp_path / "nowhere"))


def test_unmeasured_models_are_null_in_json(spark, run, tmp_path):
    metrics = spark.createDataFrame([("Linear Regression", 1.0, float("nan"), 0.5), ("Random Forest", 1.0, 0.1, None)], "model string, rmse double, r2 double, mae double")
    root = str(tmp_path / "m")
    documents.save_run({n: run.models[n] for n in ("Linear Regression", "Random Forest")}, metrics, root)
    read = documents.read_document(spark, root)
    assert read.best_model == "Random Forest" and read.models["Linear Regression"]["R2"] is None


def test_runs_are_published_once_and_removed_in_order(spark, run, tmp_path):
    root = str(tmp_path / "models")
    one = {"Linear Regression": run.models["Linear Regression"]}
    metrics = run.metrics.where("model = 'Linear Regression'")
    for run_id in ("2001", "2002", "2003"):
        documents.save_run(one, metrics, root, run_id)
    with pytest.raises(FileExistsError):
        documents.save_run(one, metrics, root, "2002")
    one["Linear Regression"].write().save(f"{root}/runs/2002b/linear_regression")  # failed long ago
    one["Linear Regression"].write().save(f"{root}/runs/9999/linear_regression")  # being written
    assert documents.read_document(spark, root).run_id == "2003" and documents.read_document(spark, root, "2001").run_id == "2001"
    with pytest.raises(ValueError):
        documents.remove_old_runs(spark, root, keep=0)
    assert documents.remove_old_runs(spark, root, keep=2) == ["2001", "2002b"]
    assert documents.published(spark, root) == ["2002", "2003"]
    assert sorted(p.name for p in (tmp_path / "models" / "runs").iterdir()) == ["2002", "2003", "9999"]
    documents.load_models(documents.read_document(spark, root, "2002"))
    assert documents.remove_old_runs(spark, str(tmp_path / "none")) == []
    assert not [p for p in (tmp_path / "models" / "documents").iterdir() if p.name.endswith(".part")]


def test_readers_never_fail_while_runs_are_swapped(spark, run, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    metrics = run.metrics.where("model = 'Linear Regression'")
    publish = lambda k: documents.save_run({}, metrics, root, f"{k:04d}")
    publish(0)
    faults, seen, done = [], set(), threading.Event()

    def read():
        while not done.is_set():
            try:
                seen.add(documents.read_document(spark, root).run_id)
            except Exception as error:  # noqa: BLE001  any failure is what this test looks for
                faults.append(error)

    readers = [threading.Thread(target=read) for _ in range(3)]
    for reader in readers:
        reader.start()
    for k in range(1, 25):
        publish(k)
        documents.remove_old_runs(spark, root, keep=1)
    done.set()
    for reader in readers:
        reader.join()
    assert not faults and len(seen) > 3
