"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Schema-tolerant union by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def dedupe_on_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Optional: one row per key after a union of overlapping pulls."""
    return df.dropDuplicates(keys)
