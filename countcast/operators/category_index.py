"""Category indexes as a table: for dimensions with too many labels for one machine.

``features.fit_indexer`` keeps all labels in one model on the driver and in every task. Here labels
are counted, numbered by frequency with ``numbering`` and joined to the rows, so the labels of a
dimension stay distributed; the driver learns only how many there are. The numbers are the
same: most frequent first, ties in alphabetical order, unseen and missing labels behind the
last one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.operators.features import Kind
from countcast.operators.numbering import numbered
from countcast.spec import CountSpec

INDEX_SCHEMA = "dimension string, value string, index double"


def category_index(df: DataFrame, spec: CountSpec) -> DataFrame:
    """``(dimension, value, index)`` of every label of every dimension; nulls are no labels."""
    if not spec.dims:
        return df.sparkSession.createDataFrame([], INDEX_SCHEMA)
    long = df.select(*(F.col(d).cast("string").alias(d) for d in spec.dims)).unpivot([], list(spec.dims), "dimension", "value")
    counted = long.where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    ranked = numbered(counted, ["dimension", F.desc("n"), "value"], "index", groups=["dimension"])
    return ranked.select("dimension", "value", F.col("index").cast("double").alias("index"))


def label_counts(index: DataFrame, spec: CountSpec) -> dict[str, int]:
    """Labels of each dimension: a number for each."""
    found = {r["dimension"]: r["n"] for r in index.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
    return {d: found.get(d, 0) for d in spec.dims}


def with_category_index(df: DataFrame, spec: CountSpec, index: DataFrame, counts: Mapping[str, int] | None = None) -> DataFrame:
    """Adds ``{dim}_idx`` for each dimension, by an equi-join with its labels.

    Small label tables are broadcast as their stored size proves it, large ones shuffled, and
    frequent labels then split at run time. The columns say how many categories they
    have, which encoders and trees need, without listing them.
    """
    counts = counts or label_counts(index, spec)
    out = df
    for dim in spec.dims:
        labels = index.where(F.col("dimension") == dim).select(F.col("value").alias(f"{dim}_label"), F.col("index").alias(f"{dim}_found"))
        nominal = {"ml_attr": {"type": "nominal", "num_vals": counts[dim] + 1}}
        position = F.coalesce(F.col(f"{dim}_found"), F.lit(float(counts[dim])))
        joined = out.join(labels, out[dim].cast("string") == labels[f"{dim}_label"], "left")
        out = joined.select(*out.columns, position.alias(f"{dim}_idx", metadata=nominal))
    return out


def with_vectors(indexed: DataFrame, spec: CountSpec, kind: Kind, counts: Mapping[str, int]) -> DataFrame:
    """Adds ``features`` as ``features.feature_stages`` does, from joined indexes."""
    year = [] if spec.year_dim is None else ["numeric_year"]
    inputs = [f"{d}_idx" for d in spec.dims]
    if kind == "linear" and spec.dims:
        # an index that never reaches its unseen bucket here must still have room for it
        blocks = [f"{d}_ohe" for d in spec.dims]
        sizes = indexed.sparkSession.createDataFrame([tuple(float(counts[d]) for d in spec.dims)], ", ".join(f"{c} double" for c in inputs))
        indexed = OneHotEncoder(inputCols=inputs, outputCols=blocks).fit(sizes).transform(indexed)
        inputs = blocks
    return VectorAssembler(inputCols=inputs + year, outputCol="features").transform(indexed)
