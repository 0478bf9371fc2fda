"""Column expressions; all of them stay inside Spark's generated code."""

from countcast.functions.columns import (
    count_prediction,
    fiscal_year,
    hash_bucket,
    log_label,
    mean_of_cents,
    null_safe_zero,
    numeric_year,
    start_year,
    storage_name,
    to_cents,
    two_decimals,
)

__all__ = [
    "count_prediction",
    "fiscal_year",
    "hash_bucket",
    "log_label",
    "mean_of_cents",
    "null_safe_zero",
    "numeric_year",
    "start_year",
    "storage_name",
    "to_cents",
    "two_decimals",
]
