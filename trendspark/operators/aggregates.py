"""Grouped aggregates.

All of them are plain ``groupBy().agg()`` plans: Spark runs a partial (map-side)
hash aggregate before the shuffle, so a group holding a third of all rows still
ships one partial row per task. Results that are ordered carry a key tie-break.
Whole-table constants (totals, means, quantiles) are scalar subqueries
(``DataFrame.scalar()``): one row, computed once, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.functions import numeric as N


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- A1 / A2 / O4: counts -------------------------------------------------------------------

def count_by(df: DataFrame, by: str | list[str], top_n: int | None = None,
             count_col: str = "video_count") -> DataFrame:
    """A1: rows per group, descending (ties by key); A2/O4 with ``top_n``."""
    keys = [by] if isinstance(by, str) else list(by)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    out = out.orderBy(F.desc(count_col), *[F.asc(k) for k in keys])
    return out.limit(top_n) if top_n else out


# --- A3: mean of one metric by group --------------------------------------------------------

def mean_by(df: DataFrame, by: str | list[str], metric: str = "engagement_score",
            alias: str = "avg_engagement") -> DataFrame:
    keys = [by] if isinstance(by, str) else list(by)
    return (df.groupBy(*keys).agg(F.avg(metric).alias(alias))
            .orderBy(F.desc(alias), *[F.asc(k) for k in keys]))


# --- A4: category statistics ----------------------------------------------------------------

def category_stats(df: DataFrame, by: str = "category_name", key: str = "video_id") -> DataFrame:
    """A4 (+P10 names): count, avg/sum views, avg likes, avg comments, avg engagement."""
    return (df.groupBy(by).agg(
        F.count(key).alias("video_count"),
        F.avg("views").alias("avg_views"),
        F.sum("views").alias("total_views"),
        F.avg("likes").alias("avg_likes"),
        F.avg("comments").alias("avg_comments"),
        F.avg("engagement_score").alias("avg_engagement"),
    ).orderBy(F.desc("video_count"), F.asc(by)))


# --- A5: channel statistics -----------------------------------------------------------------

def channel_stats(df: DataFrame, keys=("channel_id", "channel_title"), top_n: int | None = 10,
                  key: str = "video_id") -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(key).alias("video_count"),
        F.sum("views").alias("total_views"),
        F.sum("likes").alias("total_likes"),
        F.sum("comments").alias("total_comments"),
        F.avg("engagement_score").alias("avg_engagement"),
    ).orderBy(F.desc("video_count"), *[F.asc(k) for k in keys])
    return out.limit(top_n) if top_n else out


# --- A6 / A10: region x category ------------------------------------------------------------

def region_category_stats(df: DataFrame, region: str = "region", category: str = "category_name",
                          key: str = "video_id") -> DataFrame:
    return df.groupBy(region, category).agg(
        F.count(key).alias("video_count"),
        F.avg("views").alias("avg_views"),
        F.avg("likes").alias("avg_likes"),
        F.avg("comments").alias("avg_comments"),
        F.avg("engagement_score").alias("avg_engagement"),
    )


def pivot_metric(stats: DataFrame, index: str, columns: str, values: str,
                 column_values: list[str]) -> DataFrame:
    """A10: long -> wide with an explicit value list (no extra job to find the values)."""
    return stats.groupBy(index).pivot(columns, column_values).agg(F.first(values))


# --- A7 / A8 / A9: time shares and best slot ------------------------------------------------

def share_by(df: DataFrame, by: str, pct_col: str = "pct", max_key: int | None = None) -> DataFrame:
    """Percentage of all rows per key (total = scalar subquery over the same input)."""
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("video_count"))
    if max_key is not None:
        out = out.where(F.col(by) < max_key)
    return out.withColumn(pct_col, F.col("video_count") * 100.0 / total).orderBy(by)


def best_by(df: DataFrame, by: str, metric: str = "engagement_score") -> DataFrame:
    """Key with the highest mean metric; ties -> smallest key (one row)."""
    means = df.groupBy(by).agg(F.avg(metric).alias("avg_metric"))
    return means.orderBy(F.desc("avg_metric"), F.asc(by)).limit(1)


def weekday_hour_pivot(df: DataFrame, weekday: str = "publish_weekday", hour: str = "publish_hour") -> DataFrame:
    """Weekday x hour counts, all 24 hours present, zero filled."""
    hours = list(range(24))
    wide = df.groupBy(weekday).pivot(hour, hours).count().fillna(0)
    return wide.select(weekday, *[F.col(str(h)).cast("bigint").alias(f"h{h:02d}") for h in hours])


# --- A13 - A16: global means, flag shares, impacts, quartile comparison ---------------------

def global_means(df: DataFrame, metrics: list[str], key: str = "video_id") -> DataFrame:
    """One row: count and mean of each metric."""
    return df.agg(F.count(key).alias("video_count"),
                  *[F.avg(m).alias(f"avg_{m}") for m in metrics])


def flag_share(df: DataFrame, flags: list[str]) -> DataFrame:
    """Percent of rows with each 0/1 flag, ranked (one aggregate, then unpivot)."""
    wide = df.agg(*[(F.avg(f) * 100).alias(f) for f in flags])
    long = wide.unpivot([], flags, "flag", "pct")
    return long.orderBy(F.desc("pct"), F.asc("flag"))


def flag_impact(df: DataFrame, flags: list[str], metric: str = "engagement_score") -> DataFrame:
    """mean(metric | flag = 1) - mean(metric), per flag."""
    overall = F.avg(metric)
    wide = df.agg(*[(F.avg(F.when(F.col(f) == 1, F.col(metric))) - overall).alias(f) for f in flags])
    return wide.unpivot([], flags, "flag", "impact")


def quartile_compare(df: DataFrame, score: str, metrics: list[str]) -> DataFrame:
    """A16 (+P5): means of ``metrics`` in the top (>= q75) and bottom (<= q25) groups.

    Quartiles are exact (linear interpolation), found by the distributed selection in
    ``stats.exact_quantiles`` (no whole-column value map in one task).
    """
    from trendspark.operators.stats import exact_quantiles
    q25, q75 = exact_quantiles(df, score, [0.25, 0.75])
    top = F.col(score) >= F.lit(q75)
    bottom = F.col(score) <= F.lit(q25)
    wide = df.select(score, *metrics).agg(*[F.avg(F.when(top, F.col(m))).alias(f"top__{m}") for m in metrics],
                  *[F.avg(F.when(bottom, F.col(m))).alias(f"bottom__{m}") for m in metrics])
    stack = ", ".join(f"'{m}', `top__{m}`, `bottom__{m}`" for m in metrics)
    long = wide.selectExpr(f"stack({len(metrics)}, {stack}) AS (metric, top_videos, bottom_videos)")
    return long.withColumn(
        "difference",
        F.round(F.try_divide(F.col("top_videos") - F.col("bottom_videos"), F.col("bottom_videos")) * 100, 1))


# --- A22 / A23: buckets ---------------------------------------------------------------------

def title_length_buckets(df: DataFrame, length: str = "title_length",
                         metric: str = "engagement_score") -> DataFrame:
    """Engagement by right-closed title-length bucket (0,20] ... (140,160]."""
    b = df.withColumn("title_length_group",
                      N.bin_right_closed(length, S.TITLE_LENGTH_EDGES, S.TITLE_LENGTH_LABELS))
    return (b.where(F.col("title_length_group").isNotNull())
            .groupBy("title_length_group")
            .agg(F.count(F.lit(1)).alias("video_count"), F.avg(metric).alias("avg_engagement")))


def best_bucket_by_group(df: DataFrame, group: str = "category_name", seconds: str = "duration_seconds",
                         metric: str = "engagement_score") -> DataFrame:
    """A23 (+W2): per group, the duration bucket (minutes <= 60) with the highest mean metric.

    Ties -> first bucket in bucket order. The argmax runs over the small
    (group, bucket) aggregate, never over raw rows.
    """
    minutes = F.col(seconds) / 60
    b = (df.where(minutes <= 60)
         .withColumn("duration_group", N.bin_right_closed(minutes, S.DURATION_MINUTE_EDGES,
                                                          S.DURATION_MINUTE_LABELS))
         .where(F.col("duration_group").isNotNull()))
    order = F.array_position(F.array(*[F.lit(x) for x in S.DURATION_MINUTE_LABELS]), F.col("duration_group"))
    means = b.groupBy(group, "duration_group").agg(F.avg(metric).alias("avg_engagement"),
                                                   F.min(order).alias("bucket_no"))
    best = means.groupBy(group).agg(
        F.max_by(F.struct("duration_group", "avg_engagement"),
                 F.struct("avg_engagement", -F.col("bucket_no"))).alias("b"))
    return best.select(group, "b.duration_group", "b.avg_engagement")


# --- A24: word frequency --------------------------------------------------------------------

from trendspark.functions.text import WORD_RUN  # noqa: E402


def word_frequency(df: DataFrame, text: str = "title", top_n: int = 30) -> DataFrame:
    """Words of >= 3 ASCII letters that form a whole word (lower case), top n.

    A "whole word" is a maximal run of letters/numbers/underscore; it counts
    only if it is made of a-z alone. Explode then partial count before the shuffle.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_RUN), 0)
    words = df.select(F.explode(F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$"))).alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
            .orderBy(F.desc("frequency"), F.asc("word")).limit(top_n))


# --- A25 / A26 / A27 ------------------------------------------------------------------------

def growth_by_category(progression: DataFrame, by: str = "category_id") -> DataFrame:
    """Mean growth per hour by category, with the number of tracked items."""
    return (progression.groupBy(by).agg(
        F.avg("view_growth_per_hour").alias("view_growth_per_hour"),
        F.avg("like_growth_per_hour").alias("like_growth_per_hour"),
        F.avg("comment_growth_per_hour").alias("comment_growth_per_hour"),
        F.count(F.lit(1)).alias("video_count"))
        .orderBy(F.desc_nulls_last("view_growth_per_hour"), F.asc(by)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def best_row(df: DataFrame, metric: str, key: str) -> DataFrame:
    """The single row with the highest metric (ties -> smallest key)."""
    return df.orderBy(F.desc(metric), F.asc(key)).limit(1)
