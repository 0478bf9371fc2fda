"""Saved models and the nested document that names them.

Below a root folder lie ``runs/<run>/<model>``, the models of each run, and ``documents/<run>.json``:

    {"best_model": name, "models": {name: {"path": ..., "RMSE": ..., "R2": ..., "MAE": ...}}}

Paths are relative: they begin with the name of the root folder, so a reader beside it can
follow them, and a moved or renamed root still loads. A document is written under another
name and renamed when it is whole; names sort by time and the last one counts. So a
run comes into use in one step, a run that fails half way never does, and readers find a whole
document at any moment. ``metadata.json`` in the root is a copy for readers that know only that name.
Files are handled by the Hadoop file system of the path, as Spark's own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from countcast.operators.metrics import with_best
from countcast.sources.registry import model_folder, new_run_id

DOCUMENTS, RUNS, PLAIN = "documents", "runs", "metadata.json"
#: Times a reader looks again if a run is removed while it reads.
LOOKS = 5

Metrics = dict[str, float | None]


@dataclass(frozen=True)
class Document:
    """A registry document, and the folder that its paths are relative to."""

    root: str
    best_model: str
    models: Mapping[str, Mapping[str, object]]
    run_id: str | None = None

    def path(self, name: str) -> str:
        """Where a model lies now: the first part of its path stands for the root, whatever its name."""
        return f"{self.root}/{str(self.models[name]['path']).split('/', 1)[1]}"

    def chosen(self, name: str | None = None) -> str:
        chosen = name or self.best_model
        if chosen not in self.models:
            raise ValueError(f"unknown model {chosen!r}; available: {list(self.models)}")
        return chosen

    def load(self, name: str | None = None) -> tuple[str, PipelineModel]:
        chosen = self.chosen(name)
        return chosen, PipelineModel.load(self.path(chosen))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(model, path, rmse, r2, mae, is_best)``, a row a model."""
        rows = [(n, m["path"], m.get("RMSE"), m.get("R2"), m.get("MAE"), n == self.best_model) for n, m in self.models.items()]
        return spark.createDataFrame(rows, "model string, path string, rmse double, r2 double, mae double, is_best boolean")


class _Files:
    """The file system of a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; a folder that is not there has none."""
        where = self.path(folder)
        if not self.system.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(where))

    def write(self, name: str, text: str) -> None:
        """A file that appears whole or not at all; the name must be new."""
        part = self.path(f"{DOCUMENTS}/_{new_run_id()}.part")
        out = self.system.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.system.rename(part, self.path(name)):
            self.system.delete(part, False)
            raise FileExistsError(f"{self.root}/{name}")

    def replace(self, name: str, text: str) -> None:
        out = self.system.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self.system.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def save_run(models: Mapping[str, PipelineModel], metrics: DataFrame, root: str, run_id: str | None = None) -> Document:
    """Save every fitted chain below the root and, last of all, publish their document.

    A run id that is already published is refused before anything is written.
    """
    spark = metrics.sparkSession
    files = _Files(spark, root)
    run_id = run_id or new_run_id()
    if f"{run_id}.json" in files.names(DOCUMENTS):
        raise FileExistsError(f"run {run_id} of {root} is already published")
    for name, model in models.items():
        model.write().overwrite().save(f"{files.root}/{RUNS}/{run_id}/{model_folder(name)}")
    base = files.path().getName()
    rows = with_best(metrics.select("model", "rmse", "r2", "mae")).where("model is not null").collect()  # a row a model
    entries = {
        r.model: {"path": f"{base}/{RUNS}/{run_id}/{model_folder(r.model)}", "RMSE": _number(r.rmse), "R2": _number(r.r2), "MAE": _number(r.mae)}
        for r in rows
    }
    best = next(r.model for r in rows if r.is_best)
    text = json.dumps({"best_model": best, "models": entries}, indent=2)
    files.system.mkdirs(files.path(DOCUMENTS))
    files.write(f"{DOCUMENTS}/{run_id}.json", text)
    files.replace(PLAIN, text)
    return Document(files.root, best, entries, run_id)


def _number(x: float | None) -> float | None:
    """JSON has no NaN."""
    return None if x is None or math.isnan(x) else x


def published(spark: SparkSession, root: str) -> list[str]:
    """Ids of the published runs, oldest first."""
    return [n[: -len(".json")] for n in _Files(spark, root).names(DOCUMENTS) if n.endswith(".json") and not n.startswith(("_", "."))]


def read_document(spark: SparkSession, root: str, run_id: str | None = None) -> Document:
    """The document of a run, by default of the last one published; else the root's plain document."""
    files = _Files(spark, root)
    for look in range(LOOKS):
        found = run_id or next(reversed(published(spark, root)), None)
        name = f"{DOCUMENTS}/{found}.json" if found else PLAIN
        try:
            content = json.loads(files.read(name))
        except Py4JJavaError as error:
            gone = "FileNotFoundException" in error.java_exception.getClass().getName()
            if not gone or run_id or not found or look == LOOKS - 1:
                raise FileNotFoundError(f"{files.root}/{name}") from error if gone else error
            continue  # removed since it was listed: a later one has been published
        return Document(files.root, content["best_model"], content["models"], found)
    raise FileNotFoundError(files.root)


def load_models(document: Document) -> tuple[dict[str, PipelineModel], str]:
    """All models of the document, and the name of the best."""
    return {name: PipelineModel.load(document.path(name)) for name in document.models}, document.best_model


def remove_old_runs(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` published runs, and what runs that failed left behind.

    Documents go first, then the folders that no document names. A run newer than the last
    published one may be still being written and stays. Returns the ids of removed runs.
    """
    if keep < 1:
        raise ValueError("the current run must stay")
    files = _Files(spark, root)
    ids = published(spark, root)
    if not ids:
        return []
    kept = ids[-keep:]
    for run in ids[:-keep]:
        files.delete(f"{DOCUMENTS}/{run}.json")
    old = [run for run in files.names(RUNS) if run not in kept and run < ids[-1]]
    for run in old:
        files.delete(f"{RUNS}/{run}")
    return old
