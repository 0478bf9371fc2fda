"""Dense numbers for the rows of a table, in order, at any size.

A single-partition row number puts all rows into one task, and hashes of keys collide in large
tables. Here rows are range-partitioned and sorted, stored with their place in their partition,
and counted by partition; the sums of the counts before a partition plus the place are the
number. Two passes over the rows, one shuffle; the driver sees one count for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.workspace import stored

#: Column names of the steps.
_PLACE, _AT, _BEFORE = "numbering_place", "numbering_partition", "numbering_before"
_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, groups: Sequence[str] = ()) -> DataFrame:
    """All rows with a column ``name``: 0, 1, 2, ... in the given order, without gaps.

    With ``groups`` (the order must begin with them) each group starts at 0. Rows equal in ``order``
    are ordered by their other columns, so numbers do not depend on the layout; entirely equal
    rows get numbers of their own, and many of them are still spread over tasks.
    """
    by = [F.col(f"`{c}`").asc() if isinstance(c, str) else c for c in order]
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if _sortable(f.dataType.typeName())]
    kept = stored(df, "unnumbered").withColumn(_PLACE, F.monotonically_increasing_id())
    sort = [*by, *rest, F.col(_PLACE)]
    in_order = kept.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = stored(in_order.withColumn(_PLACE, F.monotonically_increasing_id()), "numbered")
    return _from_places(placed, df.columns, name, groups)


def numbered_as_stored(stored_rows: DataFrame, name: str) -> DataFrame:
    """Rows of files numbered in the order of file names and of rows within a file.

    The table must be a scan of files, with or without projections and filters; no shuffle, and
    a count for each file on the driver.
    """
    at = stored_rows.select("*", F.col("_metadata.file_path").alias(_AT), F.col("_metadata.row_index").alias(_PLACE))
    counts = at.groupBy(_AT).agg(F.count("*").alias("n"), F.max(_PLACE).alias("last")).collect()
    if any(r["n"] != r["last"] + 1 for r in counts):  # filtered rows leave gaps: store what is left
        return numbered_as_stored(stored(stored_rows, "unnumbered"), name)
    return _with_offsets(at, {r[_AT]: r["n"] for r in counts}, stored_rows.columns, name)


def numbered_in_files(scan: DataFrame, name: str) -> DataFrame:
    """As ``numbered_as_stored`` for text formats, whose scans do not know the places of rows:
    file, then begin of the split in the file, then place in the split."""
    inner = ("numbering_file", "numbering_start", "numbering_row")
    where = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    at = scan.select("*", *(c.alias(n) for c, n in zip(where, inner)))
    return numbered(at, inner, name).drop(*inner)


def _sortable(kind: str) -> bool:
    return kind not in ("map", "variant") and not kind.startswith("udt")


def _from_places(placed: DataFrame, columns: Sequence[str], name: str, groups: Sequence[str]) -> DataFrame:
    low = (1 << _ROW_BITS) - 1
    at = placed.withColumn(_AT, F.shiftright(_PLACE, _ROW_BITS)).withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit(low)))
    counts = {r[_AT]: r["n"] for r in at.groupBy(_AT).agg(F.count("*").alias("n")).collect()}
    out = _with_offsets(at, counts, columns, name)
    if not groups:
        return out
    named = {g: f"numbering_group_{i}" for i, g in enumerate(groups)}
    first = out.groupBy(*(F.col(f"`{g}`").alias(n) for g, n in named.items())).agg(F.min(f"`{name}`").alias(_BEFORE))
    same = [F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in named.items()]
    kept = [F.col(f"`{c}`") for c in columns]
    return out.join(first, same).select(*kept, (F.col(f"`{name}`") - F.col(_BEFORE)).alias(name))


def _with_offsets(at: DataFrame, counts: dict, columns: Sequence[str], name: str) -> DataFrame:
    """One row for each partition or file is broadcast: as many as the tasks of the scan."""
    keys = sorted(counts)
    before = list(accumulate((counts[k] for k in keys), initial=0))
    kind = at.schema[_AT].dataType.simpleString()
    offsets = at.sparkSession.createDataFrame(list(zip(keys, before)), f"{_AT} {kind}, {_BEFORE} bigint")
    kept = [F.col(f"`{c}`") for c in columns]
    return at.join(F.broadcast(offsets), _AT).select(*kept, (F.col(_BEFORE) + F.col(_PLACE)).alias(name))
