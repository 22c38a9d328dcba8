"""Snapshot-series queries: progression in batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.operators import aggregates as AG
from trendspark.operators import sets as U
from trendspark.sources import adapters as A
from trendspark.sources import files as SRC
from trendspark.streaming import blocks as BL
from trendspark.streaming import ingest as I
from trendspark.streaming import progression as PG
from trendspark.streaming import windows as WN

KEY = ["video_id", "category_id", "region"]

_PT = "struct_pack(t := fetch_time, id := snapshot_id, views := views, likes := likes, comments := comments)"
_PROG_INNER = f"""
SELECT video_id, category_id, region, snapshot_count, f.t AS first_time, l.t AS last_time,
       date_diff('microsecond', f.t, l.t) / 3.6e9 AS hours_tracked,
       f.views AS first_views, f.likes AS first_likes, f.comments AS first_comments,
       l.views AS last_views, l.likes AS last_likes, l.comments AS last_comments
FROM (SELECT video_id, category_id, region, count(*) AS snapshot_count, min({_PT}) AS f, max({_PT}) AS l
      FROM snapshots GROUP BY video_id, category_id, region HAVING count(*) >= 2)
"""
_PROG_SQL = f"""
SELECT *,
       CASE WHEN hours_tracked > 0 THEN round((last_views - first_views) / hours_tracked, 9) END AS view_growth_per_hour,
       CASE WHEN hours_tracked > 0 THEN round((last_likes - first_likes) / hours_tracked, 9) END AS like_growth_per_hour,
       CASE WHEN hours_tracked > 0 THEN round((last_comments - first_comments) / hours_tracked, 9) END
         AS comment_growth_per_hour
FROM ({_PROG_INNER})
"""
SQL_PROGRESSION = with_views("snapshots") + _PROG_SQL
_GROWTH = ["view_growth_per_hour", "like_growth_per_hour", "comment_growth_per_hour"]


@query("progression", SQL_PROGRESSION)
def progression(spark, sf):
    """T3 + T4 + W4 + W5: per (item, category, region): first/last snapshot, growth per hour."""
    return rounded(PG.progress(A.snapshots(spark, sf), KEY), 9, only=_GROWTH)


@query("stream_progression", SQL_PROGRESSION)
def stream_progression(spark, sf):
    """T1 + T2 + T4 on Structured Streaming: the same aggregate, drained with availableNow."""
    state = PG.snapshot_state(I.snapshot_stream(spark, sf), KEY)
    table = I.run_to_table(spark, state, "progression_state", output_mode="complete")
    return rounded(PG.progression_from_state(table, KEY), 9, only=_GROWTH)


SQL_PROGRESSION_BY_CATEGORY = with_views("snapshots") + f"""
SELECT category_id, round(avg(view_growth_per_hour), 6) AS view_growth_per_hour,
       round(avg(like_growth_per_hour), 6) AS like_growth_per_hour,
       round(avg(comment_growth_per_hour), 6) AS comment_growth_per_hour, count(*) AS video_count
FROM ({_PROG_SQL.replace("round(", "(").replace(", 9) END", ") END")}) GROUP BY category_id
"""


@query("progression_by_category", SQL_PROGRESSION_BY_CATEGORY)
def progression_by_category(spark, sf):
    """Mean growth per hour by category."""
    return rounded(AG.growth_by_category(PG.progress(A.snapshots(spark, sf), KEY)), 6)


SQL_SNAPSHOT_DELTA = with_views("snapshots") + """
SELECT snapshot_id, video_id, category_id, region, hours_since_prev, views_delta,
       round(CASE WHEN hours_since_prev > 0 THEN views_delta / hours_since_prev END, 9) AS views_delta_per_hour
FROM (SELECT snapshot_id, video_id, category_id, region,
             date_diff('microsecond', lag(fetch_time) OVER w, fetch_time) / 3.6e9 AS hours_since_prev,
             CAST(views - lag(views) OVER w AS DOUBLE) AS views_delta
      FROM snapshots WINDOW w AS (PARTITION BY video_id, category_id, region ORDER BY fetch_time, snapshot_id))
"""


@query("snapshot_delta", SQL_SNAPSHOT_DELTA)
def snapshot_delta(spark, sf):
    """W5 (row form): change since the previous snapshot of the same key, per hour."""
    d = PG.snapshot_deltas(A.snapshots(spark, sf), KEY, "fetch_time", "snapshot_id", values=["views"])
    return rounded(d.select("snapshot_id", *KEY, "hours_since_prev", "views_delta", "views_delta_per_hour"),
                   9, only=["views_delta_per_hour"])


SQL_MULTI = with_views("snapshots") + """
SELECT snapshot_id, video_id, category_id, region FROM snapshots
WHERE (video_id, category_id, region) IN (SELECT video_id, category_id, region FROM snapshots
                                          GROUP BY 1, 2, 3 HAVING count(*) > 1)
"""


@query("snapshots_multi", SQL_MULTI)
def snapshots_multi(spark, sf):
    """Snapshot rows of keys seen more than once."""
    s = A.snapshots(spark, sf).select("snapshot_id", *KEY)
    return PG.keys_with_multiple(s, KEY)


SQL_LATEST_PER_KEY = with_views("snapshots") + """
SELECT video_id, category_id, region, snapshot_id, fetch_time, views FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, category_id, region
                               ORDER BY fetch_time DESC, snapshot_id DESC) AS rn FROM snapshots)
WHERE rn = 1
"""


@query("latest_per_key", SQL_LATEST_PER_KEY)
def latest_per_key(spark, sf):
    """Newest snapshot per key (upsert semantics)."""
    s = A.snapshots(spark, sf).select(*KEY, "snapshot_id", "fetch_time", "views")
    return PG.latest_per_key(s, KEY, "fetch_time", "snapshot_id").select(
        *KEY, "snapshot_id", "fetch_time", "views")


SQL_LATEST_BATCH = with_views("snapshots") + """
SELECT snapshot_id, video_id, region, views FROM snapshots
WHERE CAST(fetch_time AS DATE) = (SELECT max(CAST(fetch_time AS DATE)) FROM snapshots)
"""


@query("latest_batch", SQL_LATEST_BATCH)
def latest_batch(spark, sf):
    """Rows of the newest collection (calendar day) via a scalar subquery on the batch column."""
    s = A.snapshots(spark, sf).withColumn("collected_on", F.to_date("fetch_time"))
    return SRC.latest_batch(s, "collected_on").select("snapshot_id", "video_id", "region", "views")


SQL_LATEST_PROGRESSION = with_views("snapshots") + f"""
SELECT * EXCLUDE (collected_week) FROM (
  SELECT *, CASE WHEN hours_tracked > 0 THEN round((last_views - first_views) / hours_tracked, 9) END
              AS view_growth_per_hour
  FROM (SELECT video_id, category_id, region, collected_week, count(*) AS snapshot_count,
               date_diff('microsecond', min({_PT}).t, max({_PT}).t) / 3.6e9 AS hours_tracked,
               min({_PT}).views AS first_views, max({_PT}).views AS last_views
        FROM (SELECT *, date_trunc('week', fetch_time) AS collected_week FROM snapshots)
        GROUP BY video_id, category_id, region, collected_week HAVING count(*) >= 2))
WHERE collected_week = (SELECT max(date_trunc('week', fetch_time)) FROM snapshots)
"""


@query("latest_progression", SQL_LATEST_PROGRESSION)
def latest_progression(spark, sf):
    """S3: progression per weekly collection; keep the newest collection's table."""
    s = A.snapshots(spark, sf).withColumn("collected_week", F.date_trunc("week", "fetch_time"))
    p = PG.progress(s, [*KEY, "collected_week"], values=["views"])
    latest = SRC.latest_batch(p, "collected_week")
    return rounded(latest.select(*KEY, "snapshot_count", "hours_tracked", "first_views", "last_views",
                                 "view_growth_per_hour"), 9, only=["view_growth_per_hour"])


SQL_SNAPSHOT_UNION = with_views("snapshots") + """
SELECT snapshot_id, video_id, views, 1 AS collection_number FROM snapshots WHERE day(fetch_time) < 15
UNION ALL
SELECT snapshot_id, video_id, views, 2 AS collection_number FROM snapshots WHERE day(fetch_time) >= 15
"""


@query("snapshot_union", SQL_SNAPSHOT_UNION)
def snapshot_union(spark, sf):
    """U2 + P6: successive snapshot batches appended into one series."""
    s = A.snapshots(spark, sf).select("snapshot_id", "video_id", "views", "fetch_time")
    first = s.where(F.dayofmonth("fetch_time") < 15).withColumn("collection_number", F.lit(1))
    second = s.where(F.dayofmonth("fetch_time") >= 15).withColumn("collection_number", F.lit(2))
    return U.union_batches([first, second]).drop("fetch_time")


SQL_TREND_DAYS = with_views("snapshots") + """
SELECT video_id, category_id, region, count(DISTINCT CAST(fetch_time AS DATE)) AS days_on_trending,
       count(*) AS snapshot_count
FROM snapshots GROUP BY 1, 2, 3
"""


@query("trend_days", SQL_TREND_DAYS)
def trend_days(spark, sf):
    """Days on trending per key."""
    return PG.trend_days(A.snapshots(spark, sf), KEY, "fetch_time")


@query("stream_trend_days", SQL_TREND_DAYS)
def stream_trend_days(spark, sf):
    """W6 online: days on trending from blocks of days, whose state leaves the store behind the watermark."""
    blocks = I.run_to_table(spark, BL.block_state(I.snapshot_stream(spark, sf), KEY), "trend_days", output_mode="update")
    return BL.merged(blocks, KEY).select(*KEY, "days_on_trending", "snapshot_count")


@query("stream_progression_online", SQL_PROGRESSION)
def stream_progression_online(spark, sf):
    """T3 + T4 online: as ``stream_progression``, with state that leaves the store behind the watermark."""
    blocks = I.run_to_table(spark, BL.block_state(I.snapshot_stream(spark, sf), KEY), "progression_blocks", output_mode="update")
    state = BL.merged(blocks, KEY).drop("days_on_trending")
    return rounded(PG.progression_from_state(state, KEY), 9, only=_GROWTH)


SQL_STREAM_WINDOWS = with_views("snapshots") + """
SELECT time_bucket(INTERVAL 6 HOUR, fetch_time) AS window_start,
       time_bucket(INTERVAL 6 HOUR, fetch_time) + INTERVAL 6 HOUR AS window_end,
       region, count(*) AS n, round(avg(views), 4) AS avg_views
FROM snapshots GROUP BY 1, 2, 3
"""


@query("stream_window_counts", SQL_STREAM_WINDOWS)
def stream_window_counts(spark, sf):
    """Streaming extension: 6-hour tumbling event-time windows per region (count, mean views)."""
    agg = WN.window_counts(I.snapshot_stream(spark, sf), "region", "fetch_time", "6 hours")
    table = I.run_to_table(spark, agg, "window_counts", output_mode="complete")
    return rounded(table, 4)


SQL_SESSIONS = with_views("snapshots") + """
SELECT video_id, category_id, region, min(fetch_time) AS session_start,
       max(fetch_time) + INTERVAL 6 HOUR AS session_end, count(*) AS snapshots
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR fetch_time >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                  OVER (PARTITION BY video_id, category_id, region ORDER BY fetch_time, snapshot_id) AS sid
      FROM (SELECT *, lag(fetch_time) OVER (PARTITION BY video_id, category_id, region
                                            ORDER BY fetch_time, snapshot_id) AS prev FROM snapshots))
GROUP BY video_id, category_id, region, sid
"""


@query("stream_sessions", SQL_SESSIONS)
def stream_sessions(spark, sf):
    """Streaming extension: trending sessions (gap 6 hours) per key, drained with availableNow.

    Complete mode without a watermark: sessions still open when the input is drained are part of the
    result, and no late row is left out, so it equals the batch ``sessions`` query. The state holds a
    row for each session, as the result does."""
    sess = WN.trending_sessions(I.snapshot_stream(spark, sf), KEY, "fetch_time", "6 hours")
    return I.run_to_table(spark, sess, "sessions", output_mode="complete")


SQL_DEDUP = with_views("snapshots") + """
SELECT DISTINCT video_id, category_id, region, fetch_time FROM snapshots
"""


@query("stream_dedup", SQL_DEDUP)
def stream_dedup(spark, sf):
    """Streaming extension: the (key, snapshot time) of each delivery, repeated ones within the watermark once."""
    d = WN.dedup_snapshots(I.snapshot_stream(spark, sf), KEY, "fetch_time", "1 hour")
    return I.run_to_table(spark, d.select(*KEY, "fetch_time"), "dedup", output_mode="append")


@query("sessions", SQL_SESSIONS)
def sessions(spark, sf):
    """Batch trending sessions (gap 6 hours): the same operator as the streaming extension."""
    return WN.trending_sessions(A.snapshots(spark, sf), KEY, "fetch_time", "6 hours")


SQL_HIST_GROWTH = with_views("snapshots") + f"""
SELECT bin, count(*) AS count, round(lo + w * bin / 30, 6) AS bin_lo, round(lo + w * (bin + 1) / 30, 6) AS bin_hi
FROM (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((g - lo) / w * 30), 29) END AS INTEGER) AS bin, lo, w
      FROM (SELECT (last_views - first_views) / hours_tracked AS g FROM ({_PROG_INNER}) WHERE hours_tracked > 0) p,
           (SELECT min(g) AS lo, max(g) - min(g) AS w FROM
              (SELECT (last_views - first_views) / hours_tracked AS g FROM ({_PROG_INNER}) WHERE hours_tracked > 0))
      WHERE g IS NOT NULL)
GROUP BY bin, lo, w
"""


@query("hist_growth", SQL_HIST_GROWTH)
def hist_growth(spark, sf):
    """30 bins of view growth per hour over the progression table."""
    from trendspark.operators import stats as ST
    p = PG.progress(A.snapshots(spark, sf), KEY).where(F.col("view_growth_per_hour").isNotNull())
    return rounded(ST.histogram(p, "view_growth_per_hour", 30), 6, only=["bin_lo", "bin_hi"])
