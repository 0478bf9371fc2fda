"""Permutation importance: how much worse models predict when one feature is shuffled.

A feature's values are dealt to other rows by a permutation that a hash of (seed, feature, row key)
fixes: the row that is k-th in key order gets the value of the row that is k-th in hash order. So
neither layout nor cluster changes it. All features are permuted by one numbering, joined
once, and scored with all models in one pass; only sums of squares are gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.operators.numbering import numbered
from countcast.plans.score import apply_models
from countcast.spec import CountSpec
from countcast.workspace import stored

#: Separates the parts of a hashed key; no text column holds it.
_SEPARATOR = "\x1f"


def with_permutations(rows: DataFrame, spec: CountSpec, keys: Sequence[str], features: Sequence[str], seed: int) -> DataFrame:
    """Each row once as it is (``feature`` null) and once for each feature with that one permuted.

    Keys must tell rows apart and not be null.
    """
    base = stored(numbered(rows, keys, "permuted_at"), "permutation-rows")
    dealt = base.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("permuted")) for f in features))))
    key = F.concat_ws(_SEPARATOR, F.lit(str(seed)), F.col("feature"), *(F.col(k).cast("string") for k in keys))
    order = ["feature", "hash", *(f"key_{i}" for i in range(len(keys)))]
    hashed = dealt.select("feature", F.md5(key).alias("hash"), *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), "permuted")
    values = numbered(hashed, order, "permuted_at", groups=["feature"]).select("feature", "permuted", "permuted_at")
    changed = [F.when(F.col("feature") == c, F.col("permuted")).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c in rows.columns]
    permuted = base.join(values, "permuted_at").select("feature", *changed)
    return base.select(F.lit(None).cast("string").alias("feature"), *rows.columns).unionByName(permuted)


def permutation_importance(
    test: DataFrame,
    spec: CountSpec,
    models: Mapping[str, PipelineModel],
    keys: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    label: str = "original_label",
    seed: int = 42,
) -> DataFrame:
    """``(model, feature, rmse, importance)``: the error with the feature permuted, and by how
    much it exceeds the error without; least important first.

    A feature that a model does not use has importance 0. The numeric year follows its
    dimension: it is read from the permuted value.
    """
    features = list(features or spec.dims)
    variants = with_permutations(test.select(*spec.dims, label), spec, list(keys or spec.dims), features, seed)
    scored, columns = apply_models(variants, spec, models)
    errors = [F.sqrt(F.avg((F.col(label) - F.col(c)) ** 2)).alias(f"rmse_{i}") for i, c in enumerate(columns.values())]
    measured = scored.groupBy("feature").agg(*errors)
    per_model = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"rmse_{i}").alias("rmse")) for i, m in enumerate(columns)))
    long = stored(measured.select("feature", F.inline(per_model)), "importance")  # a row for each feature and model
    whole = long.where("feature is null").select("model", F.col("rmse").alias("rmse_whole"))
    found = long.where("feature is not null").join(whole, "model")
    return found.select("model", "feature", "rmse", (F.col("rmse") - F.col("rmse_whole")).alias("importance")).orderBy("model", "importance", "feature")
