"""Where jobs put tables that must outlive the executors that wrote them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="countcast-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a ``local`` session without either gets a temporary folder of its own: on a
    cluster, a folder on one machine is not visible to the other executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(_local_root())
    return _local_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; two runs never write to the same one."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/countcast/{app}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: an executor lost later costs a re-read of its files, not a
    repeat of the joins behind them. Column metadata (category labels) survives.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
