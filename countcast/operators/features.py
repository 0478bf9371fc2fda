"""Feature engineering: category indexes, one-hot blocks, the numeric year, vectors."""

from __future__ import annotations

from typing import Literal

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.functions import log_label, numeric_year
from countcast.spec import CountSpec

Kind = Literal["linear", "tree"]


def with_year(df: DataFrame, spec: CountSpec) -> DataFrame:
    """Adds ``numeric_year``, a continuous feature that also covers years never seen."""
    if spec.year_dim is None:
        return df
    return df.withColumn("numeric_year", numeric_year(F.col(spec.year_dim)))


def with_labels(df: DataFrame, spec: CountSpec) -> DataFrame:
    """Adds the year, the log-space label and the count as a double."""
    target = F.col(spec.target)
    return with_year(df.dropna(subset=[spec.target]), spec).withColumns(
        {"label": log_label(target), "original_label": target.cast("double")}
    )


def fit_indexer(df: DataFrame, spec: CountSpec) -> StringIndexerModel | None:
    """Labels of all dimensions from one job, however many dimensions there are.

    Most frequent label first, ties in alphabetical order; unseen labels keep an index of
    their own.
    """
    if not spec.dims:
        return None
    indexes = [f"{d}_idx" for d in spec.dims]
    return StringIndexer(inputCols=list(spec.dims), outputCols=indexes, handleInvalid="keep").fit(df)


def feature_stages(spec: CountSpec, kind: Kind, indexer: StringIndexerModel | None = None) -> list:
    """Stages for one kind of model. Both kinds start with the same indexer, which may be
    passed in already fitted.

    Linear models get one-hot blocks, where an unseen label is all zeros. Trees take the
    indexes directly and treat each as one categorical feature.
    """
    indexes = [f"{d}_idx" for d in spec.dims]
    year = [] if spec.year_dim is None else ["numeric_year"]
    stages: list = []
    inputs = indexes
    if spec.dims:
        unfitted = StringIndexer(inputCols=list(spec.dims), outputCols=indexes, handleInvalid="keep")
        stages.append(indexer or unfitted)
        if kind == "linear":
            inputs = [f"{d}_ohe" for d in spec.dims]
            stages.append(OneHotEncoder(inputCols=indexes, outputCols=inputs))
    stages.append(VectorAssembler(inputCols=inputs + year, outputCol="features"))
    return stages


def fit_features(
    df: DataFrame, spec: CountSpec, kind: Kind, indexer: StringIndexerModel | None = None
) -> PipelineModel:
    """With a fitted indexer this reads no data: block widths come from its labels."""
    return Pipeline(stages=feature_stages(spec, kind, indexer)).fit(df)


def indexer_of(model: PipelineModel) -> StringIndexerModel | None:
    return next((s for s in model.stages if isinstance(s, StringIndexerModel)), None)


def largest_arity(model: PipelineModel) -> int:
    """Most labels of any dimension, not counting the unseen bucket."""
    indexer = indexer_of(model)
    return max((len(labels) for labels in indexer.labelsArray), default=0) if indexer else 0


def label_table(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Learned labels as ``(dimension, value, index)``; as small as the fitted model itself."""
    indexer = indexer_of(model)
    rows = [
        (dim, label, float(i))
        for dim, labels in zip(indexer.getInputCols(), indexer.labelsArray)
        for i, label in enumerate(labels)
    ]
    return df.sparkSession.createDataFrame(rows, "dimension string, value string, index double")


def vector_slots(df: DataFrame, keys: list[str], nonzero_only: bool = False) -> DataFrame:
    """Feature vectors for inspection: ``(*keys, slot, weight)``, one row per slot."""
    slots = df.select(*keys, F.posexplode(vector_to_array("features")).alias("slot", "weight"))
    return slots.filter("weight <> 0") if nonzero_only else slots
