"""Feature blocks combined into one wide table (one projection + one grouped join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.operators.lookups import attach_group_stats


def channel_features(df: DataFrame, channel: str = "channel_id", score: str = "engagement_score",
                     min_rows: int | None = None) -> DataFrame:
    """W1 + J2 + J3 + F8: channel count, channel mean score (with ``min_rows`` only when the batch
    has more rows than that, as the original) and score / channel mean (missing mean -> 1). Where the
    mean is 0, the quotient is that of IEEE doubles, as in the SQL: 0 / 0 is NaN, and no error."""
    out = attach_group_stats(df, [channel], {
        "channel_video_count": F.count(F.lit(1)),
        "_channel_avg": F.avg(score),
    })
    mean = F.col("_channel_avg")
    if min_rows is not None:
        mean = F.when(df.select(F.count(F.lit(1))).scalar() > min_rows, mean)
    out = out.withColumn("channel_avg_engagement", mean).drop("_channel_avg")
    own, mean = F.col(score), F.coalesce(F.col("channel_avg_engagement"), F.lit(1.0))
    return out.withColumn("relative_engagement", F.when(mean != 0, own / mean).otherwise(own * F.lit(float("inf"))))
