"""Reproducible hash split and hash sample (the same arithmetic runs in SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(key, buckets: int = 100) -> Column:
    """First 32 bits of md5(key) mod ``buckets``."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def hash_split_flag(key, test_fraction: float = 0.2) -> Column:
    """True for the test side. Splitting by a group key (e.g. the item, not the row) keeps
    every copy of one item on one side (D14)."""
    return hash_bucket(key, 100) < int(round(test_fraction * 100))


def split(df: DataFrame, key: str, test_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    flag = hash_split_flag(key, test_fraction)
    return df.where(~flag), df.where(flag)


def fold_column(key, folds: int = 5) -> Column:
    """k-fold assignment by key hash (used as ``foldCol`` in cross-validation)."""
    return hash_bucket(key, 100 * folds) % folds


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """N rows in the order of md5(key:seed) -> same rows every run, any partitioning."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(order, F.asc(key)).limit(n)
