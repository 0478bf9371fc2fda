"""Configurable row filters: per-dimension lists of allowed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countcast.operators.options import option_catalogue
from countcast.spec import CountSpec
from countcast.workspace import stored

# Longer lists become a semi join, keeping the plan and its generated code small.
MAX_INLINE_VALUES = 1_000

Allowed = Mapping[str, Sequence[str] | DataFrame | None]


def allowed_rows(df: DataFrame, config: Allowed) -> DataFrame:
    """Rows whose every configured dimension holds an allowed value; ``None`` allows all.

    Short lists are pushed to the scan as ``IN`` predicates. Long lists, and lists given
    as a one-column DataFrame, are semi-joined; Spark broadcasts them if their size, which
    is known by then, is below its threshold.
    """
    inline = {d: v for d, v in config.items() if v is not None and not _is_table(v)}
    kept = df.filter(_allowed(inline)) if inline else df
    for dim, values in config.items():
        if values is None or dim in inline:
            continue
        kept = kept.join(_values_table(df, dim, values), dim, "left_semi")
    return kept.select(*df.columns)


def kept_of_total(df: DataFrame, config: Allowed) -> DataFrame:
    """``(kept, total)`` in one pass; with listed tables, kept rows are counted by a join."""
    inline = {d: v for d, v in config.items() if v is not None and not _is_table(v)}
    marked, conditions = df, [_allowed(inline)]
    for dim, values in config.items():
        if values is None or dim in inline:
            continue
        flag = f"_listed_{dim}"
        marked = marked.join(_values_table(df, dim, values).withColumn(flag, F.lit(True)), dim, "left")
        conditions.append(F.col(flag).isNotNull())
    keep = reduce(Column.__and__, conditions)
    return marked.agg(F.count_if(keep).alias("kept"), F.count("*").alias("total"))


def unknown_values(df: DataFrame, spec: CountSpec, config: Allowed) -> DataFrame:
    """Configured values that no row has, as ``(dimension, value)``.

    A misspelt value would otherwise silently filter everything away.
    """
    wanted = [
        _values_table(df, dim, values).select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"))
        for dim, values in config.items()
        if values is not None
    ]
    if not wanted:
        return df.sparkSession.createDataFrame([], "dimension string, value string")
    dims = [d for d, v in config.items() if v is not None]
    known = option_catalogue(df, spec.with_dims(*dims))
    return reduce(DataFrame.unionByName, wanted).join(known, ["dimension", "value"], "left_anti")


def _is_table(values: Sequence[str] | DataFrame) -> bool:
    return isinstance(values, DataFrame) or len(values) > MAX_INLINE_VALUES


def _allowed(config: Mapping[str, Sequence[str]]) -> Column:
    return reduce(Column.__and__, (F.col(d).isin(list(v)) for d, v in config.items()), F.lit(True))


def _values_table(df: DataFrame, dim: str, values: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(values, DataFrame):
        # Stored first, so that its true size decides between broadcast and shuffle; an
        # estimate could shuffle all facts by a key of a few values.
        return stored(values.select(F.col(values.columns[0]).alias(dim)).distinct(), "allowed")
    rows = [(v,) for v in dict.fromkeys(values)]
    return df.sparkSession.createDataFrame(rows, f"`{dim}` string")
