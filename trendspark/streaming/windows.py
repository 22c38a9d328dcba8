"""Event-time extensions around the snapshot stream: tumbling counts, trending sessions, dedup.

Watermarks bound the state: with ``watermark`` set, windows older than the
watermark are finalised and dropped from the state store, and late rows beyond
it are ignored. Spark requires a TIMESTAMP (not TIMESTAMP_NTZ) event-time
column for a watermark, so the column is cast with the session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _event_time(df: DataFrame, time: str, watermark: str | None) -> tuple[DataFrame, str]:
    if watermark is None:
        return df, time
    df = df.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", watermark)
    return df, "_event_time"


def window_counts(df: DataFrame, by: str = "region", time: str = "fetch_time", size: str = "1 hour",
                  slide: str | None = None, value: str = "views", watermark: str | None = None) -> DataFrame:
    """Tumbling (or sliding) event-time windows: rows and mean value per key."""
    df, t = _event_time(df, time, watermark)
    w = F.window(F.col(t), size, slide) if slide else F.window(F.col(t), size)
    g = df.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"avg_{value}"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n",
                    f"avg_{value}")


def trending_sessions(df: DataFrame, key, time: str = "fetch_time", gap: str = "1 hour",
                      watermark: str | None = None) -> DataFrame:
    """Runs of snapshots of one key with gaps below ``gap`` (session windows)."""
    df, t = _event_time(df, time, watermark)
    g = df.groupBy(F.session_window(F.col(t), gap).alias("s"), *key).agg(F.count(F.lit(1)).alias("snapshots"))
    return g.select(*key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "snapshots")


def dedup_snapshots(df: DataFrame, key, time: str = "fetch_time", watermark: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of the same (key, snapshot time) within the watermark."""
    df = df.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", watermark)
    return df.dropDuplicatesWithinWatermark([*key, time]).drop("_event_time")
