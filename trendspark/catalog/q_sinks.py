"""Sink/scan round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.operators import filters as P
from trendspark.sources import adapters as A
from trendspark.sources import files as SRC
from trendspark.session import scratch_path
from trendspark.streaming import progression as PG

SQL_SINK = with_views("snapshots") + """
SELECT category_id, count(*) AS n, CAST(sum(views) AS BIGINT) AS total_views FROM snapshots
WHERE region = 'ASIA'
  AND CAST(fetch_time AS DATE) = (SELECT max(CAST(fetch_time AS DATE)) FROM snapshots WHERE region = 'ASIA')
GROUP BY category_id
"""


@query("sink_roundtrip", SQL_SINK)
def sink_roundtrip(spark, sf):
    """S6-S8 + P1 + S2: snapshots written partitioned by (collected_on, region); the region filter
    and the newest-batch filter then prune directories on the way back in."""
    path = scratch_path(spark, "snapshots-silver")
    s = A.snapshots(spark, sf).withColumn("collected_on", F.to_date("fetch_time"))
    SRC.write_partitioned(s.select("snapshot_id", "video_id", "category_id", "views", "fetch_time",
                                   "collected_on", "region"), path, ("collected_on", "region"))
    back = P.filter_region(spark.read.parquet(path), "ASIA")
    newest = SRC.latest_batch(back, "collected_on")
    return newest.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("views").cast("bigint").alias("total_views"))


SQL_CSV = with_views("ve") + """
SELECT region, count(*) AS n, count(publish_time) AS parsed_times, CAST(sum(views) AS BIGINT) AS total_views,
       round(avg(likes), 6) AS avg_likes, count(DISTINCT category_id) AS categories
FROM ve GROUP BY region
"""


@query("csv_roundtrip", SQL_CSV)
def csv_roundtrip(spark, sf):
    """S13 + S1 + S4: a processed batch written as CSV and scanned back with the fixed snapshot
    schema (text -> typed with try_cast / try_to_timestamp, NaN -> null)."""
    path = scratch_path(spark, "batch-csv")
    v = A.videos(spark, sf).select(
        *[(F.col(f.name).cast("string") if f.name in ("video_id", "channel_id", "publish_time", "fetch_time")
           else F.col(f.name)).alias(f.name) if f.name in
          ("video_id", "channel_id", "channel_title", "publish_time", "fetch_time", "category_id", "views",
           "likes", "comments", "region") else F.lit(None).cast("string").alias(f.name)
          for f in S.SNAPSHOT_SCHEMA.fields])
    SRC.write_table(v, path, fmt="csv")
    back = SRC.read_snapshots(spark, path, fmt="csv")
    out = back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("publish_time").alias("parsed_times"),
                                     F.sum("views").cast("bigint").alias("total_views"),
                                     F.avg("likes").alias("avg_likes"),
                                     F.count_distinct("category_id").alias("categories"))
    return rounded(out, 6)


SQL_UPSERT = with_views("snapshots") + """
SELECT video_id, category_id, region, snapshot_id, fetch_time, views FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, category_id, region
                               ORDER BY fetch_time DESC, snapshot_id DESC) AS rn FROM snapshots)
WHERE rn = 1
"""


@query("upsert_roundtrip", SQL_UPSERT)
def upsert_roundtrip(spark, sf):
    """Overlapping pulls merged as upsert (union + newest row per key), stored and read back."""
    s = A.snapshots(spark, sf).select("video_id", "category_id", "region", "snapshot_id", "fetch_time", "views")
    existing = s.where(F.dayofmonth("fetch_time") < 20)
    updates = s.where(F.dayofmonth("fetch_time") >= 10)
    merged = SRC.upsert_latest(existing, updates, ["video_id", "category_id", "region"], "fetch_time")
    path = scratch_path(spark, "upsert")
    SRC.write_table(merged, path)
    return spark.read.parquet(path).select("video_id", "category_id", "region", "snapshot_id", "fetch_time",
                                           "views")


SQL_SNAPSHOT_SINK = with_views("snapshots") + """
SELECT snapshot_id, video_id, category_id, region, fetch_time, views, likes, comments FROM snapshots
"""


@query("stream_snapshot_sink", SQL_SNAPSHOT_SINK)
def stream_snapshot_sink(spark, sf):
    """T2 + S12: the tagged snapshot stream appended to a Parquet table (a replayed batch replaces itself)."""
    from trendspark.streaming import ingest as I
    return I.run_to_table(spark, I.snapshot_stream(spark, sf), "snapshot-sink", output_mode="append")
