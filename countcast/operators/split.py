"""Train/test splits and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.functions import hash_bucket


def in_training(keys: Sequence[str], train_percent: int = 80):
    return hash_bucket(keys, 100) < train_percent


def split(df: DataFrame, keys: Sequence[str], train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete (train, test) parts decided by each row's key alone."""
    chosen = in_training(keys, train_percent)
    return df.filter(chosen), df.filter(~chosen)


def random_split(df: DataFrame, train_percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; its outcome depends on how the input is partitioned."""
    share = train_percent / 100
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test


def with_fold(df: DataFrame, keys: Sequence[str], folds: int = 3, column: str = "fold") -> DataFrame:
    """A fold number from other digits of the key's hash than ``split`` uses."""
    return df.withColumn(column, hash_bucket(keys, folds, offset=8).cast("int"))


def fold_sizes(df: DataFrame, keys: Sequence[str], folds: int = 3) -> DataFrame:
    return with_fold(df, keys, folds).groupBy("fold").agg(F.count("*").alias("rows"))
