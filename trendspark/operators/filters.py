"""Projections and filters (P1-P16) and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL_CATEGORIES = "All Categories"


def filter_region(df: DataFrame, region: str, col: str = "region") -> DataFrame:
    """Equality on the partition column (pruned when the table is partitioned by it)."""
    return df.where(F.col(col) == F.lit(region))


def filter_category(df: DataFrame, category: str | None, by: str = "category_id") -> DataFrame:
    """Optional category filter; None / '' / 'All Categories' = no filter."""
    if not category or category == ALL_CATEGORIES:
        return df
    return df.where(F.col(by) == F.lit(category))


def filter_range(df: DataFrame, col: str, lo=None, hi=None, hi_inclusive: bool = False) -> DataFrame:
    """Range predicate (pushed to the scan when ``col`` is a stored column)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= lo)
    if hi is not None:
        cond = cond & ((F.col(col) <= hi) if hi_inclusive else (F.col(col) < hi))
    return df.where(cond)


def keep_top_k_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """P4 + J7: keep rows of the k largest groups (count desc, key asc) via a left semi join.

    The top-k side has at most k rows, a proven bound, so it is broadcast.
    """
    top = (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc(group)).limit(k).select(group))
    return df.join(F.broadcast(top), group, "left_semi")


def tag_batch(df: DataFrame, **constants) -> DataFrame:
    """Constant columns such as region, collection time, collection number."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop identifier columns; absent names are ignored."""
    return df.drop(*cols)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.BooleanType)


def numeric_only(df: DataFrame) -> DataFrame:
    """Keep numeric (and boolean) columns."""
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)])


def top_n(df: DataFrame, metric: str, key: str, n: int = 1000) -> DataFrame:
    """O1/O2/O3: order by metric desc with a key tie-break, limit n (TakeOrderedAndProject)."""
    return df.orderBy(F.desc(metric), F.asc(key)).limit(n)


def trending_order(df: DataFrame, key: str = "video_id", n: int = 1000) -> DataFrame:
    """O1: popularity_score if present, else views."""
    metric = "popularity_score" if "popularity_score" in df.columns else "views"
    return top_n(df, metric, key, n)


RECORD_COLUMNS = [
    ("video_id", None), ("title", ""), ("channel_title", ""), ("category_name", "Unknown"),
    ("views", 0), ("likes", 0), ("comments", 0), ("publish_time", None), ("duration_seconds", 0),
    ("engagement_score", 0.0), ("thumbnail_url", None), ("region", ""),
]


def response_record(df: DataFrame, include_absent: bool = False) -> DataFrame:
    """Project to the trending record with defaults; absent columns are skipped
    (or filled with their default when ``include_absent``)."""
    cols: list[Column] = []
    for name, default in RECORD_COLUMNS:
        if name in df.columns:
            col = F.col(name)
            if name == "publish_time":
                col = col.cast("string")
            elif default is not None:
                col = F.coalesce(col, F.lit(default))
            cols.append(col.alias(name))
        elif include_absent:
            cols.append(F.lit(default).alias(name))
    return df.select(*cols)


def chart_points(df: DataFrame, cols: list[str], label_cols: list[str] = ()) -> DataFrame:
    """log10 coordinates for points with all values > 0."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > 0)
    return df.where(cond).select(*label_cols, *[F.log10(F.col(c)).alias(f"log_{c}") for c in cols])


def ensure_engagement(df: DataFrame) -> DataFrame:
    """Derive the (uncapped) engagement score only when it is absent."""
    if "engagement_score" in df.columns:
        return df
    from trendspark.functions.numeric import engagement_score
    return df.withColumn("engagement_score", engagement_score(cap=None))


def deterministic_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Reproducible uniform sample of n rows: order by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.asc(key)).limit(n)
