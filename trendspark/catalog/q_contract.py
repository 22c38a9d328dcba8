"""Contract analyses with declared formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog import sql_text as Q
from trendspark.catalog.common import event_times, ve
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import text as TX
from trendspark.plans import analysis as AN
from trendspark.sources.adapters import texts

_PR = ("((percent_rank() OVER (ORDER BY {v}) * 0.5 + percent_rank() OVER (ORDER BY avg_engagement) * 0.3)"
       " + percent_rank() OVER (ORDER BY video_count) * 0.2) * 100")

_CH_CTE = f""", chs AS (SELECT channel_id, channel_title, count(video_id) AS video_count,
       CAST(sum(views) AS BIGINT) AS total_views, avg(views) AS views_per_video,
       round(avg(engagement_score), 9) AS avg_engagement FROM ve GROUP BY channel_id, channel_title),
ch AS (SELECT *, {_PR.format(v='views_per_video')} AS channel_score FROM chs)
"""
SQL_CHANNEL_PERF = with_views("ve") + _CH_CTE + """
SELECT channel_id, channel_title, video_count, total_views, round(views_per_video, 6) AS views_per_video,
       avg_engagement, round(channel_score, 6) AS channel_score FROM ch
"""


@query("channel_performance", SQL_CHANNEL_PERF)
def channel_performance(spark, sf):
    """A28 + W7: channel table with a 0-100 percent-rank score (distributed exact ranks)."""
    return rounded(AN.channel_performance(ve(spark, sf)), 6, only=["views_per_video", "channel_score"])


SQL_TOP_CHANNEL_SCORES = with_views("ve") + _CH_CTE + """
SELECT channel_id, channel_title, round(channel_score, 6) AS channel_score FROM ch
ORDER BY channel_score DESC, channel_id LIMIT 15
"""


@query("top_channel_scores", SQL_TOP_CHANNEL_SCORES)
def top_channel_scores(spark, sf):
    """O3: top 15 channels by score."""
    perf = AN.channel_performance(ve(spark, sf))
    top = perf.orderBy(F.desc("channel_score"), F.asc("channel_id")).limit(15)
    return rounded(top.select("channel_id", "channel_title", "channel_score"), 6)


_BUCKET_HI = "CASE " + " ".join(
    f"WHEN duration_seconds / 60 > {lo} AND duration_seconds / 60 <= {hi} THEN {float(hi)}"
    for lo, hi in zip(S.DURATION_MINUTE_EDGES[:-1], S.DURATION_MINUTE_EDGES[1:])) + " END"
_TOD = ("CASE WHEN h IS NULL THEN NULL WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' "
        "WHEN h >= 17 AND h < 22 THEN 'evening' ELSE 'night' END")
_CAT_CTE = f""", cs AS (SELECT category_name, count(video_id) AS video_count, avg(views) AS avg_views,
       round(avg(engagement_score), 9) AS avg_engagement FROM ve GROUP BY category_name),
sc AS (SELECT *, {_PR.format(v='avg_views')} AS category_score FROM cs),
d AS (SELECT category_name, bucket_hi, avg(engagement_score) AS m
      FROM (SELECT category_name, engagement_score, {_BUCKET_HI} AS bucket_hi FROM ve)
      WHERE bucket_hi IS NOT NULL GROUP BY category_name, bucket_hi),
bd AS (SELECT category_name, arg_min(bucket_hi, (-m, bucket_hi)) AS optimal_duration_minutes FROM d GROUP BY 1),
t AS (SELECT category_name, tod, list_position(['morning', 'afternoon', 'evening', 'night'], tod) AS tod_no,
             avg(engagement_score) AS m
      FROM (SELECT category_name, engagement_score, {_TOD} AS tod FROM (SELECT *, hour(publish_time) AS h FROM ve))
      GROUP BY category_name, tod),
bt AS (SELECT category_name, arg_min(tod, (-m, tod_no)) AS optimal_time_of_day FROM t GROUP BY 1),
cat AS (SELECT sc.*, optimal_duration_minutes, optimal_time_of_day
        FROM sc LEFT JOIN bd USING (category_name) LEFT JOIN bt USING (category_name))
"""
SQL_CATEGORY_PERF = with_views("ve") + _CAT_CTE + """
SELECT category_name, video_count, round(avg_views, 6) AS avg_views, avg_engagement,
       round(category_score, 6) AS category_score, optimal_duration_minutes, optimal_time_of_day FROM cat
"""


@query("category_performance", SQL_CATEGORY_PERF)
def category_performance(spark, sf):
    """Category table with score, optimal duration bucket and time of day."""
    return rounded(AN.category_performance(ve(spark, sf)), 6, only=["avg_views", "category_score"])


SQL_HOURLY = with_views("snapshots") + """
SELECT CAST(hour(fetch_time) AS INTEGER) AS publish_hour, round(avg(views), 4) AS avg_engagement,
       count(*) AS video_count FROM snapshots GROUP BY 1
"""


@query("time_patterns_hourly", SQL_HOURLY)
def time_patterns_hourly(spark, sf):
    """A30 hourly_stats (snapshot value stands for engagement)."""
    return rounded(AN.hourly_stats(event_times(spark, sf), metric="views"), 4)


SQL_DAILY = with_views("snapshots") + """
SELECT CAST(isodow(fetch_time) - 1 AS INTEGER) AS publish_weekday, round(avg(views), 4) AS avg_engagement,
       count(*) AS video_count,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(fetch_time)] AS day_name
FROM snapshots GROUP BY 1, 4
"""


@query("time_patterns_daily", SQL_DAILY)
def time_patterns_daily(spark, sf):
    """A30 day_stats with day names, calendar order."""
    return rounded(AN.day_stats(event_times(spark, sf), metric="views"), 4)


_TR_CTE = """, hs AS (SELECT CAST(hour(fetch_time) AS INTEGER) AS h, avg(views) AS m FROM snapshots GROUP BY 1),
ds AS (SELECT CAST(isodow(fetch_time) - 1 AS INTEGER) AS d, avg(views) AS m FROM snapshots GROUP BY 1),
tr AS (SELECT ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][
                (SELECT arg_min(d, (-m, d)) FROM ds) + 1] AS best_day_name,
              (SELECT arg_min(h, (-m, h)) FROM hs) AS best_hour),
trb AS (SELECT *, CASE WHEN best_hour >= 5 AND best_hour < 12 THEN 'Morning'
                       WHEN best_hour >= 12 AND best_hour < 17 THEN 'Afternoon'
                       WHEN best_hour >= 17 AND best_hour < 21 THEN 'Evening' ELSE 'Night' END AS best_time_of_day
        FROM tr)
"""
SQL_TIME_REC = with_views("snapshots") + _TR_CTE + "SELECT * FROM trb"


@query("time_patterns", SQL_TIME_REC)
def time_patterns(spark, sf):
    """A30 recommendations: best day name, best hour, best time of day."""
    return AN.time_recommendations(event_times(spark, sf), metric="views")


_TITLE_FLAGS = ["title_has_question", "title_has_exclamation", "title_has_number", "clickbait_score"]
_TF_SQL = [s for s in Q.title_features("title") if any(s.endswith(f"AS {f}") for f in _TITLE_FLAGS)]
_INSIGHT_CTE = _CH_CTE + _CAT_CTE + _TR_CTE + f""", g AS (SELECT count(*) AS n, avg(views) AS v, avg(likes) AS l,
       avg(comments) AS c, avg(like_view_ratio) AS lvr, avg(comment_view_ratio) AS cvr,
       avg(duration_seconds) / 60 AS dm FROM ve),
tf AS (SELECT l.quality, {", ".join(_TF_SQL)} FROM texts LEFT JOIN labels l USING (doc_id)),
ti AS (SELECT {", ".join(f"avg(CASE WHEN {f} = 1 THEN quality END) - avg(quality) AS {f}" for f in _TITLE_FLAGS[:3])},
       CASE WHEN stddev_pop(clickbait_score) > 0 AND stddev_pop(quality) > 0 THEN corr(clickbait_score, quality) END
         AS cb FROM tf),
tc AS (SELECT * FROM cat ORDER BY category_score DESC, category_name LIMIT 1),
th AS (SELECT * FROM ch ORDER BY channel_score DESC, channel_id LIMIT 1)
"""
_ROWS = [
    ("g", "summary", "total_videos", "n", None),
    ("tc", "category", "top_category", "category_score", "category_name"),
    ("tc", "category", "optimal_duration_minutes", "optimal_duration_minutes", None),
    ("tc", "category", "best_time_to_post", None, "optimal_time_of_day"),
    ("th", "channel", "top_channel", "channel_score", "channel_title"),
    ("th", "channel", "videos_in_trending", "video_count", None),
    ("th", "channel", "average_views", "views_per_video", None),
    ("trb", "time", "best_day", None, "best_day_name"),
    ("trb", "time", "best_hour", "best_hour", None),
    ("trb", "time", "best_time_of_day", None, "best_time_of_day"),
    ("ti", "title", "question_impact", "title_has_question", None),
    ("ti", "title", "exclamation_impact", "title_has_exclamation", None),
    ("ti", "title", "number_impact", "title_has_number", None),
    ("ti", "title", "clickbait_correlation", "cb", None),
    ("g", "general", "average_views", "v", None),
    ("g", "general", "average_likes", "l", None),
    ("g", "general", "average_comments", "c", None),
    ("g", "general", "average_like_view_ratio", "lvr", None),
    ("g", "general", "average_comment_view_ratio", "cvr", None),
    ("g", "general", "average_duration_minutes", "dm", None),
]
SQL_INSIGHT = with_views("ve", "snapshots", "texts") + _INSIGHT_CTE + "\nUNION ALL\n".join(
    f"SELECT '{sec}' AS section, '{met}' AS metric, "
    f"{'round(CAST(' + num + ' AS DOUBLE), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS value_num, "
    f"{'CAST(' + txt + ' AS VARCHAR)' if txt else 'CAST(NULL AS VARCHAR)'} AS value_text FROM {src}"
    for src, sec, met, num, txt in _ROWS)


@query("insight_report", SQL_INSIGHT)
def insight_report(spark, sf):
    """The insight report as rows, one union of small aggregates."""
    v = ve(spark, sf)
    feats = TX.title_features("title")
    titles = texts(spark, sf, with_labels=True).select("quality", *[feats[f].alias(f) for f in _TITLE_FLAGS])
    rep = AN.insight_report(v, AN.channel_performance(v), AN.category_performance(v),
                            AN.time_recommendations(event_times(spark, sf), metric="views"), titles)
    return rounded(rep, 6)
