from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_year(fiscal_year: Column) -> Column:
    """``'2016/17'`` -> ``2016.0``; what does not begin with four digits gives null."""
    return F.when(fiscal_year.rlike(r"^[0-9]{4}"), F.substring(fiscal_year, 1, 4).try_cast("double"))


def start_year(fiscal_year: Column) -> Column:
    """``'2016/17'`` -> ``2016``: the part before the slash as an integer."""
    return F.split_part(fiscal_year, F.lit("/"), F.lit(1)).try_cast("int")


def fiscal_year(first_year: Column) -> Column:
    """``2016`` -> ``'2016/17'``."""
    following = F.lpad(((first_year + 1) % 100).cast("string"), 2, "0")
    return F.concat(first_year.cast("string"), F.lit("/"), following)


def log_label(count: Column) -> Column:
    """Training label: ``log(1 + count)``, defined at zero."""
    return F.log1p(count.cast("double"))


def count_prediction(prediction: Column) -> Column:
    """Back from log space to a count, never below one."""
    return F.greatest(F.expm1(prediction), F.lit(1.0))


def two_decimals(value: Column) -> Column:
    return F.round(value, 2)


def to_cents(value: Column) -> Column:
    """A two-decimal value as whole hundredths.

    Sums of whole numbers are exact, so means built from them do not depend on
    partitioning or on the order in which tasks finish.
    """
    return F.round(two_decimals(value) * 100).cast("long")


def mean_of_cents(cents: Column, rows: Column) -> Column:
    """Mean of two-decimal values, rounded half up to two decimals."""
    return F.floor(cents / rows + 0.5) / 100


def null_safe_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def storage_name(name: Column) -> Column:
    """Folder name of a model: lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(name), " -", "__")


def hash_bucket(keys: Sequence[str], buckets: int, offset: int = 0) -> Column:
    """Bucket 0..buckets-1 from the md5 of the key columns.

    A row's bucket depends on its key alone, never on partition layout, so a retried
    task or a different cluster size gives the same split. ``offset`` selects other
    hex digits of the hash (0, 8 or 16) for an independent second draw. Key columns must
    not be null: ``concat_ws`` skips nulls.
    """
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    digits = F.substring(F.md5(text), offset + 1, 8)
    return F.conv(digits, 16, 10).cast("long") % buckets
