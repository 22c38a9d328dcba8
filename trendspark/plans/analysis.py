"""Composite analyses whose formulas are declared here.

The analysed application calls a processing module that is not part of its
source tree, so only the output column names are known. The formulas below are
ours and are stated in each docstring (and mirrored in the oracle SQL):

channel_score / category_score = 100 * (0.5 * pr(views per item) + 0.3 * pr(mean engagement)
                                        + 0.2 * pr(item count)),
where pr is the exact percent rank over all channels (categories); mean engagement is
rounded to 9 decimals before ranking so equal means rank equal on every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.functions import numeric as N
from trendspark.functions import temporal as TM
from trendspark.operators.stats import safe_corr
from trendspark.session import shared_dir
from trendspark.operators.windows import argmax_per_group, global_percent_rank

SCORE_WEIGHTS = {"views_per_video": 0.5, "avg_engagement": 0.3, "video_count": 0.2}


def _scored(stats: DataFrame, out: str) -> DataFrame:
    # three ranks read the same per-channel (per-category) table: compute it once
    shared_dir(stats.sparkSession)
    stats = stats.checkpoint(eager=True)
    for c in SCORE_WEIGHTS:
        stats = global_percent_rank(stats, c, f"_pr_{c}")
    score = sum((F.col(f"_pr_{c}") * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0)) * 100
    return stats.withColumn(out, score).drop(*[f"_pr_{c}" for c in SCORE_WEIGHTS])


def channel_performance(df: DataFrame, keys=("channel_id", "channel_title"), key: str = "video_id") -> DataFrame:
    """A28 + W7: per channel: video_count, total_views, views_per_video, avg_engagement, channel_score."""
    stats = df.groupBy(*keys).agg(
        F.count(key).alias("video_count"),
        F.sum("views").alias("total_views"),
        F.avg("views").alias("views_per_video"),
        F.round(F.avg("engagement_score"), 9).alias("avg_engagement"))
    return _scored(stats, "channel_score")


def category_performance(df: DataFrame, by: str = "category_name", key: str = "video_id",
                         seconds: str = "duration_seconds", hour: str | None = None) -> DataFrame:
    """Per category: video_count, avg_views, avg_engagement, category_score,
    optimal_duration_minutes (upper edge of the best right-closed minute bucket, <= 60 min),
    optimal_time_of_day (time of day with the best mean engagement; ties -> first of
    morning, afternoon, evening, night)."""
    stats = df.groupBy(by).agg(
        F.count(key).alias("video_count"),
        F.avg("views").alias("views_per_video"),
        F.round(F.avg("engagement_score"), 9).alias("avg_engagement"))
    scored = _scored(stats, "category_score").withColumnRenamed("views_per_video", "avg_views")

    minutes = F.col(seconds) / 60
    edges = S.DURATION_MINUTE_EDGES
    bucket_hi = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (minutes > lo) & (minutes <= hi)
        bucket_hi = F.when(cond, F.lit(float(hi))) if bucket_hi is None else bucket_hi.when(cond, F.lit(float(hi)))
    dur = (df.select(by, bucket_hi.alias("bucket_hi"), "engagement_score").where(F.col("bucket_hi").isNotNull())
           .groupBy(by, "bucket_hi").agg(F.avg("engagement_score").alias("m")))
    best_dur = argmax_per_group(dur, by, "m", "bucket_hi").select(
        by, F.col("bucket_hi").alias("optimal_duration_minutes"))

    h = F.col(hour) if hour else F.hour(F.col("publish_time"))
    tod_order = F.array_position(F.array(*[F.lit(x) for x in ["morning", "afternoon", "evening", "night"]]),
                                 TM.time_of_day(h))
    tod = (df.select(by, TM.time_of_day(h).alias("optimal_time_of_day"), tod_order.alias("tod_no"),
                     "engagement_score")
           .groupBy(by, "optimal_time_of_day", "tod_no").agg(F.avg("engagement_score").alias("m")))
    best_tod = argmax_per_group(tod, by, "m", "tod_no").select(by, "optimal_time_of_day")
    return scored.join(best_dur, by, "left").join(best_tod, by, "left")


def hourly_stats(df: DataFrame, hour: str = "publish_hour", metric: str = "engagement_score") -> DataFrame:
    """A30 part 1."""
    return df.groupBy(hour).agg(F.avg(metric).alias("avg_engagement"), F.count(F.lit(1)).alias("video_count"))


def day_stats(df: DataFrame, weekday: str = "publish_weekday", metric: str = "engagement_score") -> DataFrame:
    """A30 part 2 (ordered by calendar day, O7)."""
    return (df.groupBy(weekday).agg(F.avg(metric).alias("avg_engagement"), F.count(F.lit(1)).alias("video_count"))
            .withColumn("day_name", TM.day_name(weekday)).orderBy(weekday))


def time_recommendations(df: DataFrame, hour: str = "publish_hour", weekday: str = "publish_weekday",
                         metric: str = "engagement_score") -> DataFrame:
    """A30 part 3 + A8: one row: best_day_name, best_hour, best_time_of_day (serving evening end 21)."""
    hs = hourly_stats(df, hour, metric).withColumn("_k", F.lit(0))
    ds = day_stats(df, weekday, metric).withColumn("_k", F.lit(0))
    best_h = argmax_per_group(hs, "_k", "avg_engagement", hour).select("_k", F.col(hour).alias("best_hour"))
    best_d = argmax_per_group(ds, "_k", "avg_engagement", weekday).select(
        "_k", TM.day_name(weekday).alias("best_day_name"))
    # both sides are single rows (aggregates over at most 24 and 7 keys)
    out = best_d.join(F.broadcast(best_h), "_k").drop("_k")
    return out.withColumn("best_time_of_day", TM.time_of_day("best_hour", evening_end=21, capitalized=True))


def insight_report(videos: DataFrame, channel_perf: DataFrame, category_perf: DataFrame,
                   time_rec: DataFrame, titles: DataFrame) -> DataFrame:
    """The insight report as (section, metric, value_num, value_text) rows.

    The five inputs are reduced to one row each (A13, A15, A27-A30), put side by side
    with left joins on a constant key (every side has at most one row), and the wide
    row is exploded into report lines - one plan, each subplan evaluated once."""
    k = F.lit(0).alias("_k")
    top_cat = (category_perf.orderBy(F.desc("category_score"), F.asc("category_name")).limit(1)
               .select(k, "category_name", "category_score", "optimal_duration_minutes", "optimal_time_of_day"))
    top_ch = (channel_perf.orderBy(F.desc("channel_score"), F.asc("channel_id")).limit(1)
              .select(k, "channel_title", "channel_score", "video_count", "views_per_video"))
    g = videos.agg(F.count(F.lit(1)).alias("n"), F.avg("views").alias("v"), F.avg("likes").alias("l"),
                   F.avg("comments").alias("c"), F.avg("like_view_ratio").alias("lvr"),
                   F.avg("comment_view_ratio").alias("cvr"), (F.avg("duration_seconds") / 60).alias("dm")
                   ).withColumn("_k", F.lit(0))
    overall = F.avg("quality")
    t = titles.agg(*[(F.avg(F.when(F.col(f) == 1, F.col("quality"))) - overall).alias(f)
                     for f in ["title_has_question", "title_has_exclamation", "title_has_number"]],
                   safe_corr("clickbait_score", "quality").alias("cb")).withColumn("_k", F.lit(0))
    tr = time_rec.select(k, "best_day_name", "best_hour", "best_time_of_day")
    wide = g.join(top_cat, "_k", "left").join(top_ch, "_k", "left").join(tr, "_k", "left").join(t, "_k", "left")

    def line(section, metric, num=None, text=None):
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        (F.col(num) if num else F.lit(None)).cast("double").alias("value_num"),
                        (F.col(text) if text else F.lit(None)).cast("string").alias("value_text"))

    lines = [
        line("summary", "total_videos", "n"),
        line("category", "top_category", "category_score", "category_name"),
        line("category", "optimal_duration_minutes", "optimal_duration_minutes"),
        line("category", "best_time_to_post", text="optimal_time_of_day"),
        line("channel", "top_channel", "channel_score", "channel_title"),
        line("channel", "videos_in_trending", "video_count"),
        line("channel", "average_views", "views_per_video"),
        line("time", "best_day", text="best_day_name"),
        line("time", "best_hour", "best_hour"),
        line("time", "best_time_of_day", text="best_time_of_day"),
        line("title", "question_impact", "title_has_question"),
        line("title", "exclamation_impact", "title_has_exclamation"),
        line("title", "number_impact", "title_has_number"),
        line("title", "clickbait_correlation", "cb"),
        line("general", "average_views", "v"),
        line("general", "average_likes", "l"),
        line("general", "average_comments", "c"),
        line("general", "average_like_view_ratio", "lvr"),
        line("general", "average_comment_view_ratio", "cvr"),
        line("general", "average_duration_minutes", "dm"),
    ]
    return wide.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def engagement_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(N.engagement_columns())
