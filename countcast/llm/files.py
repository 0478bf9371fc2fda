"""Binary files that tasks write to, and read from, the shared folder.

A task writes a file under a name of its own and reports it in a row; the rows are written as
a table. A file of a lost or repeated task is in no row, so nobody reads it.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from countcast.workspace import scratch_path


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; it exists when this returns."""
    uri = scratch_path(spark, label)
    where, path = opened(uri)
    where.create_dir(path, recursive=True)
    return uri


def fresh_name(folder: str, ending: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{ending}"
