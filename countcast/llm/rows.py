"""A key of its own for each row of a table, and whole rows through Arrow whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.workspace import stored


#: What keeps at most one row for each row of a file.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan is one scan, projected and filtered."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        if plan.nodeName().split(" ")[0] not in _PLAIN:
            return False
        children = plan.children()
        if children.size() != 1:
            return children.isEmpty()
        plan = children.head()


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """A 64-bit key from the row's file and place in it: the same whenever the table is read.

    A table that is not a scan of files, or that may have several rows for one of a file (by
    ``explode``, a join or a union), is stored first. A column that is itself called
    ``_metadata`` does no harm.
    """
    if not _is_scan(df):
        return _numbered(stored(df, "rows"), name)
    try:
        located = _numbered(df, name)
        located.schema  # noqa: B018  raises where the rows do not come from files
        return located
    except AnalysisException as error:
        if "_metadata" not in str(error):
            raise
    return _numbered(stored(df, "rows"), name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    place = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(place["file_path"], place["row_index"]).alias(name))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` that also takes columns with a dot or a backtick in their names."""
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(run, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"column_{i}" for i in range(len(names)))).mapInArrow(named, schema)
