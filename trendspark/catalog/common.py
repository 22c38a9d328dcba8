"""Shared Spark-side views for the registered queries (mirrors ``views_sql``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions import numeric as N
from trendspark.functions import temporal as TM
from trendspark.sources import adapters as A


def ve(spark: SparkSession, sf: str) -> DataFrame:
    """videos + F3/F4 engagement columns."""
    return A.videos(spark, sf).withColumns(N.engagement_columns())


def vf(spark: SparkSession, sf: str) -> DataFrame:
    """ve + F28 hours since published + F5 rates."""
    v = ve(spark, sf)
    h = TM.hours_between("publish_time", "fetch_time")
    v = v.withColumn("hours_since_published", h)
    return v.withColumns({
        "views_per_hour": N.per_hour("views", "hours_since_published"),
        "likes_per_hour": N.per_hour("likes", "hours_since_published"),
        "comments_per_hour": N.per_hour("comments", "hours_since_published"),
    })


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with F24/F25 time parts on the snapshot time (the only source with clock times)."""
    s = A.snapshots(spark, sf)
    return s.withColumns(TM.time_parts("fetch_time"))


REGION_VALUES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
