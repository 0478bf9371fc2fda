from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from countcast.queries.models import closed_form_run
from countcast.sources import facts as source
from countcast.sources import registry
from countcast.spec import ENROLMENT_HEADERS, HEADCOUNT
from countcast.workspace import scratch_path, shared_root, stored
from tests.conftest import SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("format", source.FORMATS)
def test_facts_survive_every_format(spark, facts, spec, tmp_path, format):
    source.write_facts(facts, f"{tmp_path}/f", format)
    back = source.read_facts(spark, f"{tmp_path}/f", spec, format)
    assert back.schema == spec.fact_schema()
    assert rows(back) == rows(facts)


def test_csv_with_the_original_headers(spark, tmp_path):
    header = ",".join(ENROLMENT_HEADERS)
    line = "2023/24,Fall term,Undergraduate,Bachelors,3,Main,MATH,Computer Science,Co-op,Academic Term,Full-Time,Canadian,42"
    (tmp_path / "e.csv").write_text(f"{header}\n{line}\n")
    for infer in (False, True):
        read = source.read_facts(spark, f"{tmp_path}/e.csv", HEADCOUNT, "csv", ENROLMENT_HEADERS, infer)
        assert read.schema == HEADCOUNT.fact_schema()
        assert tuple(read.first()) == (*line.split(",")[:-1], 42)


def test_csv_with_other_headers_is_an_error(spark, tmp_path, spec):
    (tmp_path / "e.csv").write_text("a,b,c,d,e\n1,2,3,4,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        source.read_facts(spark, f"{tmp_path}/e.csv", spec, "csv").collect()


def test_unknown_format(spark, spec):
    with pytest.raises(ValueError, match="xml"):
        source.read_facts(spark, "nowhere", spec, "xml")


def test_a_request_without_a_dimension_is_refused(spark, spec):
    with pytest.raises(Exception, match="(?i)null"):
        source.requests_from_rows(spark, [{"fiscal_year": "2019/20"}], spec).collect()


IN_OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession
from countcast.workspace import scratch_path, shared_root, stored

shared = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", shared).getOrCreate())
assert shared_root(spark) == shared
assert scratch_path(spark, "x").startswith(shared + "/countcast/")
table = stored(spark.range(3).toDF("n"), "numbers")
assert shared in table.inputFiles()[0] and table.count() == 3
assert shared in spark.sparkContext.getCheckpointDir()
"""


def test_shared_folder_comes_from_the_session(tmp_path):
    """The setting is fixed when a context starts, so this takes a session of its own."""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", IN_OTHER_SESSION, f"{tmp_path}/shared"],
        cwd=root, capture_output=True, text=True, timeout=120,
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_two_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_registry_reports_the_latest_complete_run(spark, tmp_path):
    run = closed_form_run(spark, SMALL)
    root = str(tmp_path / "models")
    first = registry.save_run(run.models, run.metrics, root)
    second = registry.save_run(run.models, run.metrics, root)
    assert first < second
    saved = registry.read_registry(spark, root)
    assert all(f"/runs/{second}/" in r.path for r in saved.collect())
    document = registry.registry_document(saved).first()
    assert document.best_model == run.best
    assert set(document.models) == set(run.models)
    assert set(document.models[run.best].asDict()) == {"path", "RMSE", "R2", "MAE"}


def test_choosing_models(spark, tmp_path):
    run = closed_form_run(spark, SMALL)
    root = str(tmp_path / "models")
    registry.save_run(run.models, run.metrics, root)
    saved = registry.read_registry(spark, root)
    assert registry.choose_model(saved)[0] == run.best
    assert registry.choose_model(saved, "Random Forest")[1].endswith("/random_forest")
    with pytest.raises(ValueError, match="available"):
        registry.choose_model(saved, "No Such Model")
    assert registry.load_model(saved, "Linear Regression")[0] == "Linear Regression"


def test_folder_names_agree_between_driver_and_column(spark):
    from countcast.functions import storage_name

    names = ["Linear Regression", "Gradient-Boosted Trees", "Random Forest"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(storage_name(df.name)).collect()] == [registry.model_folder(n) for n in names]
