"""Descriptive analytics queries (ingest lookups, A1-A10, A26, O1-O4, J1, J7, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog.common import REGION_VALUES, event_times, ve
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.operators import aggregates as AG
from trendspark.operators import filters as P
from trendspark.operators import lookups as J
from trendspark.operators import sets as U
from trendspark.functions import temporal as TM

# ---------------------------------------------------------------------------------------------
SQL_CATEGORY_STATS = with_views("ve") + """
SELECT category_name, count(video_id) AS video_count, round(avg(views), 4) AS avg_views,
       CAST(sum(views) AS BIGINT) AS total_views, round(avg(likes), 4) AS avg_likes,
       round(avg(comments), 4) AS avg_comments, round(avg(engagement_score), 4) AS avg_engagement
FROM ve WHERE region = 'ASIA' GROUP BY category_name
"""


@query("category_stats", SQL_CATEGORY_STATS)
def category_stats(spark, sf):
    """P1 + A4 + P10: category statistics for one region."""
    return rounded(AG.category_stats(P.filter_region(ve(spark, sf), "ASIA")))


# ---------------------------------------------------------------------------------------------
SQL_TRENDING_TOPN = with_views("ve") + """
SELECT video_id, channel_title, coalesce(category_name, 'Unknown') AS category_name, views, likes,
       comments, CAST(publish_time AS VARCHAR) AS publish_time, duration_seconds, engagement_score, region
FROM ve WHERE region = 'EUROPE' AND category_id = '1'
ORDER BY views DESC, video_id LIMIT 100
"""


@query("trending_topn", SQL_TRENDING_TOPN)
def trending_topn(spark, sf):
    """P1 + P2 + O1 + P11: top-n trending list of one region and category."""
    v = P.filter_category(P.filter_region(ve(spark, sf), "EUROPE"), "1")
    top = P.top_n(v, "views", "video_id", 100)
    return P.response_record(top)


# ---------------------------------------------------------------------------------------------
SQL_REGION_CATEGORY = with_views("ve") + """
SELECT region, category_name, count(video_id) AS video_count, round(avg(views), 4) AS avg_views,
       round(avg(likes), 4) AS avg_likes, round(avg(comments), 4) AS avg_comments,
       round(avg(engagement_score), 4) AS avg_engagement
FROM ve GROUP BY region, category_name
"""


@query("region_category_stats", SQL_REGION_CATEGORY)
def region_category_stats(spark, sf):
    """A6."""
    return rounded(AG.region_category_stats(ve(spark, sf)))


SQL_REGION_CATEGORY_PIVOT = with_views("ve") + "SELECT category_name, " + ", ".join(
    f"round(avg(CASE WHEN region = '{r}' THEN engagement_score END), 4) AS \"{r}\"" for r in REGION_VALUES
) + " FROM ve GROUP BY category_name"


@query("region_category_pivot", SQL_REGION_CATEGORY_PIVOT)
def region_category_pivot(spark, sf):
    """A6 -> A10: avg engagement, category x region, explicit pivot values."""
    stats = AG.region_category_stats(ve(spark, sf))
    return rounded(AG.pivot_metric(stats, "category_name", "region", "avg_engagement", REGION_VALUES))


# ---------------------------------------------------------------------------------------------
SQL_CHANNEL_TOPN = with_views("ve") + """
SELECT channel_id, channel_title, count(video_id) AS video_count, CAST(sum(views) AS BIGINT) AS total_views,
       CAST(sum(likes) AS BIGINT) AS total_likes, CAST(sum(comments) AS BIGINT) AS total_comments,
       round(avg(engagement_score), 4) AS avg_engagement
FROM ve WHERE region = 'AMERICA' GROUP BY channel_id, channel_title
ORDER BY video_count DESC, channel_id, channel_title LIMIT 10
"""


@query("channel_stats_topn", SQL_CHANNEL_TOPN)
def channel_stats_topn(spark, sf):
    """P1 + A5: top channels of a region by trending count."""
    return rounded(AG.channel_stats(P.filter_region(ve(spark, sf), "AMERICA"), top_n=10))


SQL_TOP_CHANNELS = with_views("videos") + """
SELECT channel_title, count(*) AS video_count FROM videos GROUP BY channel_title
ORDER BY video_count DESC, channel_title LIMIT 20
"""


@query("top_channels_count", SQL_TOP_CHANNELS)
def top_channels_count(spark, sf):
    """A2: top 20 channels by number of trending items."""
    from trendspark.sources.adapters import videos
    return AG.count_by(videos(spark, sf), "channel_title", top_n=20)


# ---------------------------------------------------------------------------------------------
SQL_CATEGORY_COUNTS = with_views("videos") + """
SELECT category_name, count(*) AS video_count FROM videos GROUP BY category_name
"""


@query("category_counts", SQL_CATEGORY_COUNTS)
def category_counts(spark, sf):
    """A1."""
    from trendspark.sources.adapters import videos
    return AG.count_by(videos(spark, sf), "category_name")


SQL_DISTINCT_CATEGORIES = with_views("videos") + """
SELECT DISTINCT category_name FROM videos WHERE category_name IS NOT NULL
"""


@query("distinct_categories", SQL_DISTINCT_CATEGORIES)
def distinct_categories(spark, sf):
    """A26."""
    from trendspark.sources.adapters import videos
    return AG.distinct_values(videos(spark, sf), "category_name")


SQL_DISTINCT_REGIONS = with_views("texts") + """
SELECT DISTINCT region FROM texts WHERE region IS NOT NULL
"""


@query("distinct_regions", SQL_DISTINCT_REGIONS)
def distinct_regions(spark, sf):
    """A26 on the text table (regions = languages)."""
    from trendspark.sources.adapters import texts
    return AG.distinct_values(texts(spark, sf), "region")


SQL_ENGAGEMENT_BY_CATEGORY = with_views("ve") + """
SELECT category_name, round(avg(engagement_score), 4) AS avg_engagement FROM ve GROUP BY category_name
"""


@query("engagement_by_category", SQL_ENGAGEMENT_BY_CATEGORY)
def engagement_by_category(spark, sf):
    """A3."""
    return rounded(AG.mean_by(ve(spark, sf), "category_name"))


# ---------------------------------------------------------------------------------------------
_DIM_SQL = "(VALUES " + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in S.CATEGORY_NAMES.items()
) + ") AS dim(category_id, category_name)"

SQL_CATEGORY_LOOKUP = with_views("videos") + f"""
SELECT v.video_id, v.category_id, coalesce(dim.category_name, 'Unknown') AS category_label
FROM videos v LEFT JOIN {_DIM_SQL} ON v.category_id = dim.category_id
"""


@query("category_lookup_left", SQL_CATEGORY_LOOKUP)
def category_lookup_left(spark, sf):
    """S5 + J1: category name from the fixed 32-row dimension (broadcast), miss -> Unknown."""
    from trendspark.sources.adapters import videos
    v = videos(spark, sf).select("video_id", "category_id")
    return J.category_lookup(spark, v, out_col="category_label").select(
        "video_id", "category_id", "category_label")


SQL_TOP_CATEGORY_SEMI = with_views("videos") + """
SELECT video_id, category_name FROM videos
WHERE category_name IN (SELECT category_name FROM videos GROUP BY category_name
                        ORDER BY count(*) DESC, category_name LIMIT 3)
"""


@query("top_category_semi", SQL_TOP_CATEGORY_SEMI)
def top_category_semi(spark, sf):
    """O4 + J7 + P4: rows whose category is among the top 3 by count (left semi join)."""
    from trendspark.sources.adapters import videos
    v = videos(spark, sf).select("video_id", "category_name")
    return P.keep_top_k_groups(v, "category_name", 3)


# ---------------------------------------------------------------------------------------------
SQL_REGION_UNION = with_views("videos") + """
SELECT video_id, region, NULL::VARCHAR AS category_id, views, 'region' AS pull, 1 AS collection_number
FROM videos
UNION ALL
SELECT video_id, NULL::VARCHAR AS region, category_id, views, 'category' AS pull, 1 AS collection_number
FROM videos
"""


@query("region_union_batches", SQL_REGION_UNION)
def region_union_batches(spark, sf):
    """P6 + U1 + D9: region pull and the pulls of all categories unioned by name, missing columns null, duplicates kept."""
    from trendspark.sources.adapters import videos
    v = videos(spark, sf)
    region_pull = P.tag_batch(v.select("video_id", "region", "views"), pull="region", collection_number=1)
    category_pull = P.tag_batch(v.select("video_id", "category_id", "views"), pull="category", collection_number=1)
    return U.union_batches([region_pull, category_pull]).select(
        "video_id", "region", "category_id", "views", "pull", "collection_number")


# ---------------------------------------------------------------------------------------------
SQL_REGION_UNION_ALL = with_views("videos") + """
SELECT video_id, region, NULL::VARCHAR AS category_id, views, 'region' AS pull, 1 AS collection_number
FROM videos
UNION ALL
SELECT video_id, NULL::VARCHAR AS region, category_id, views, 'category' AS pull, 1 AS collection_number
FROM videos
"""


@query("region_union_all_categories", SQL_REGION_UNION_ALL)
def region_union_all_categories(spark, sf):
    """P6 + U1 + D9: region pull and the pulls of all categories unioned by name, duplicates kept."""
    from trendspark.sources.adapters import videos
    v = videos(spark, sf)
    region_pull = P.tag_batch(v.select("video_id", "region", "views"), pull="region", collection_number=1)
    category_pulls = P.tag_batch(v.select("video_id", "category_id", "views"), pull="category", collection_number=1)
    return U.union_batches([region_pull, category_pulls]).select(
        "video_id", "region", "category_id", "views", "pull", "collection_number")


# ---------------------------------------------------------------------------------------------
SQL_HOUR_SHARE = with_views("snapshots") + """
SELECT CAST(hour(fetch_time) AS INTEGER) AS publish_hour, count(*) AS video_count,
       CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM snapshots) AS pct
FROM snapshots GROUP BY 1
"""


@query("hour_share", SQL_HOUR_SHARE)
def hour_share(spark, sf):
    """Share of snapshots per hour of day."""
    return AG.share_by(event_times(spark, sf), "publish_hour")


SQL_WEEKDAY_SHARE = with_views("snapshots") + """
SELECT CAST(isodow(fetch_time) - 1 AS INTEGER) AS publish_weekday, count(*) AS video_count,
       CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM snapshots) AS pct,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(fetch_time)] AS day_name
FROM snapshots GROUP BY 1, 4
"""


@query("weekday_share", SQL_WEEKDAY_SHARE)
def weekday_share(spark, sf):
    """A7 + O7 + F31: share per weekday (Mon=0), ordered by calendar day, with day names."""
    out = AG.share_by(event_times(spark, sf), "publish_weekday", max_key=7)
    return out.withColumn("day_name", TM.day_name("publish_weekday"))


SQL_BEST_HOUR = with_views("snapshots") + """
SELECT publish_hour, round(avg_metric, 4) AS avg_metric,
       CASE WHEN publish_hour >= 5 AND publish_hour < 12 THEN 'Morning'
            WHEN publish_hour >= 12 AND publish_hour < 17 THEN 'Afternoon'
            WHEN publish_hour >= 17 AND publish_hour < 21 THEN 'Evening' ELSE 'Night' END AS best_time_of_day
FROM (SELECT CAST(hour(fetch_time) AS INTEGER) AS publish_hour, avg(views) AS avg_metric
      FROM snapshots GROUP BY 1 ORDER BY avg_metric DESC, publish_hour LIMIT 1)
"""


@query("best_hour", SQL_BEST_HOUR)
def best_hour(spark, sf):
    """A8 + F26 (API evening end 21): hour with the highest mean value, ties -> smallest hour."""
    best = AG.best_by(event_times(spark, sf), "publish_hour", "views")
    return rounded(best.withColumn("best_time_of_day",
                                   TM.time_of_day("publish_hour", evening_end=21, capitalized=True)))


SQL_BEST_DAY = with_views("snapshots") + """
SELECT publish_weekday, round(avg_metric, 4) AS avg_metric,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][publish_weekday + 1] AS best_day
FROM (SELECT CAST(isodow(fetch_time) - 1 AS INTEGER) AS publish_weekday, avg(views) AS avg_metric
      FROM snapshots GROUP BY 1 ORDER BY avg_metric DESC, publish_weekday LIMIT 1)
"""


@query("best_day", SQL_BEST_DAY)
def best_day(spark, sf):
    """A8 + F31: weekday with the highest mean value."""
    best = AG.best_by(event_times(spark, sf), "publish_weekday", "views")
    return rounded(best.withColumn("best_day", TM.day_name("publish_weekday")))


SQL_WEEKDAY_HOUR_PIVOT = with_views("snapshots") + "SELECT publish_weekday, " + ", ".join(
    f"CAST(count(CASE WHEN publish_hour = {h} THEN 1 END) AS BIGINT) AS h{h:02d}" for h in range(24)
) + """ FROM (SELECT CAST(isodow(fetch_time) - 1 AS INTEGER) AS publish_weekday,
                   CAST(hour(fetch_time) AS INTEGER) AS publish_hour FROM snapshots) GROUP BY 1"""


@query("weekday_hour_pivot", SQL_WEEKDAY_HOUR_PIVOT)
def weekday_hour_pivot(spark, sf):
    """A9."""
    return AG.weekday_hour_pivot(event_times(spark, sf))
