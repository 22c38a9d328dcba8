"""Numeric, temporal and statistics queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog.common import REGION_VALUES, event_times, ve, vf
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import numeric as N
from trendspark.functions import temporal as TM
from trendspark.ml import targets as TG
from trendspark.operators import aggregates as AG
from trendspark.operators import filters as P
from trendspark.operators import lookups as J
from trendspark.operators import stats as ST
from trendspark.sources import adapters as A
from trendspark.sources.tables import read_table, spread


def _case_bins(x: str, edges, labels) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                              for lo, hi, lab in zip(edges[:-1], edges[1:], labels)) + " END"


def _case_duration(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} < {b} THEN '{lab}'" for b, lab in S.DURATION_CATEGORY_BOUNDS)
            + f" ELSE '{S.DURATION_CATEGORY_ELSE}' END")


def _case_delay(h: str) -> str:
    return (f"CASE WHEN {h} IS NULL THEN NULL " + " ".join(f"WHEN {h} < {b} THEN '{lab}'" for b, lab in S.DELAY_BOUNDS)
            + f" ELSE '{S.DELAY_ELSE}' END")


def _case_tod(h: str, evening_end: int = 22) -> str:
    return (f"CASE WHEN {h} IS NULL THEN NULL WHEN {h} >= 5 AND {h} < 12 THEN 'morning' "
            f"WHEN {h} >= 12 AND {h} < 17 THEN 'afternoon' WHEN {h} >= 17 AND {h} < {evening_end} THEN 'evening' "
            f"ELSE 'night' END")


# ---------------------------------------------------------------------------------------------
SQL_ENGAGEMENT_METRICS = with_views("ve") + """
SELECT video_id, like_view_ratio, comment_view_ratio, engagement_score,
       duration_seconds / 60 AS duration_minutes,
       round(ln(1 + views), 9) AS views_log, round(ln(1 + duration_seconds), 9) AS duration_log,
       CAST(likes AS DOUBLE) AS likes_num
FROM ve
"""


@query("engagement_metrics", SQL_ENGAGEMENT_METRICS)
def engagement_metrics(spark, sf):
    """Ratios (capped), engagement score, duration minutes and logs."""
    v = ve(spark, sf)
    out = v.select(
        "video_id", "like_view_ratio", "comment_view_ratio", "engagement_score",
        N.duration_minutes("duration_seconds").alias("duration_minutes"),
        N.log1p("views").alias("views_log"), N.log1p("duration_seconds").alias("duration_log"),
        N.to_number("likes").alias("likes_num"))
    return rounded(out, 9, only=["views_log", "duration_log"])


SQL_RATES = with_views("vf") + """
SELECT video_id, hours_since_published, views_per_hour, likes_per_hour, comments_per_hour,
       round(views / greatest(hours_since_published, 1.0 / 60) * ln(1 + views)
             / sqrt(greatest(hours_since_published, 1.0)), 9) AS virality_score,
       round(engagement_score / ln(1 + greatest(hours_since_published, 1.0 / 60)), 9) AS age_adjusted_engagement
FROM vf
"""


@query("rate_virality_age_adjusted", SQL_RATES)
def rate_virality_age_adjusted(spark, sf):
    """F5-F7 + F28: per-hour rates, virality, age-adjusted engagement."""
    v = vf(spark, sf)
    out = v.select("video_id", "hours_since_published", "views_per_hour", "likes_per_hour", "comments_per_hour",
                   N.virality("views", "hours_since_published").alias("virality_score"),
                   N.age_adjusted("engagement_score", "hours_since_published").alias("age_adjusted_engagement"))
    return rounded(out, 9, only=["virality_score", "age_adjusted_engagement"])


# ---------------------------------------------------------------------------------------------
_H = "date_diff('microsecond', publish_time, fetch_time) / 3.6e9"
SQL_TEMPORAL = with_views("snapshots") + f"""
SELECT snapshot_id, publish_hour, publish_dom, publish_month, publish_year, publish_weekday,
       CAST(publish_weekday >= 5 AS INTEGER) AS publish_weekend, publish_quarter,
       {_case_tod('publish_hour')} AS time_of_day,
       CAST({_case_tod('publish_hour')} = 'morning' AS INTEGER) AS publish_morning,
       CAST({_case_tod('publish_hour')} = 'afternoon' AS INTEGER) AS publish_afternoon,
       CAST({_case_tod('publish_hour')} = 'evening' AS INTEGER) AS publish_evening,
       CAST({_case_tod('publish_hour')} = 'night' AS INTEGER) AS publish_night,
       hours_since_published, hours_since_published / 24 AS days_since_published,
       {_case_delay('hours_since_published')} AS trending_delay,
       CAST({_case_delay('hours_since_published')} = 'same_day' AS INTEGER) AS trending_same_day,
       CAST({_case_delay('hours_since_published')} = 'next_day' AS INTEGER) AS trending_next_day,
       CAST({_case_delay('hours_since_published')} = 'same_week' AS INTEGER) AS trending_same_week,
       CAST({_case_delay('hours_since_published')} = 'later' AS INTEGER) AS trending_later
FROM (SELECT snapshot_id, CAST(hour(fetch_time) AS INTEGER) AS publish_hour,
             CAST(day(fetch_time) AS INTEGER) AS publish_dom, CAST(month(fetch_time) AS INTEGER) AS publish_month,
             CAST(year(fetch_time) AS INTEGER) AS publish_year,
             CAST(isodow(fetch_time) - 1 AS INTEGER) AS publish_weekday,
             CAST(quarter(fetch_time) AS INTEGER) AS publish_quarter, {_H} AS hours_since_published
      FROM snapshots)
"""


@query("temporal_parts", SQL_TEMPORAL)
def temporal_parts(spark, sf):
    """S4/F24-F26/F28/F29 + F15 dummies on snapshot times."""
    s = event_times(spark, sf)
    s = s.withColumns({"time_of_day": TM.time_of_day("publish_hour"),
                       "hours_since_published": TM.hours_between("publish_time", "fetch_time")})
    s = s.withColumns({"days_since_published": F.col("hours_since_published") / 24,
                       "trending_delay": TM.delay_category("hours_since_published")})
    tod = N.one_hot("time_of_day", ["morning", "afternoon", "evening", "night"], "publish")
    delay = N.one_hot("trending_delay", ["same_day", "next_day", "same_week", "later"], "trending")
    s = s.withColumns({**tod, **delay})
    return s.select("snapshot_id", "publish_hour", "publish_dom", "publish_month", "publish_year",
                    "publish_weekday", "publish_weekend", "publish_quarter", "time_of_day", *tod.keys(),
                    "hours_since_published", "days_since_published", "trending_delay", *delay.keys())


_TWO_PI = repr(2 * math.pi)
SQL_CYCLIC = with_views("snapshots") + f"""
SELECT snapshot_id,
       round(sin({_TWO_PI} * h / 24), 9) AS hour_sin, round(cos({_TWO_PI} * h / 24), 9) AS hour_cos,
       round(sin({_TWO_PI} * d / 31), 9) AS day_sin, round(cos({_TWO_PI} * d / 31), 9) AS day_cos,
       round(sin({_TWO_PI} * m / 12), 9) AS month_sin, round(cos({_TWO_PI} * m / 12), 9) AS month_cos,
       round(sin({_TWO_PI} * w / 7), 9) AS dayofweek_sin, round(cos({_TWO_PI} * w / 7), 9) AS dayofweek_cos
FROM (SELECT snapshot_id, hour(fetch_time) AS h, day(fetch_time) AS d, month(fetch_time) AS m,
             isodow(fetch_time) - 1 AS w FROM snapshots)
"""


@query("cyclic_time", SQL_CYCLIC)
def cyclic_time(spark, sf):
    """sin/cos of hour, day, month, weekday."""
    s = event_times(spark, sf)
    return rounded(s.select("snapshot_id", *[c.alias(n) for n, c in TM.cyclic_columns().items()]), 9)


SQL_TIME_OF_DAY = with_views("snapshots") + f"""
SELECT h AS publish_hour, {_case_tod('h', 22)} AS time_of_day_features,
       {_case_tod('h', 21)} AS time_of_day_serving, count(*) AS n
FROM (SELECT CAST(hour(fetch_time) AS INTEGER) AS h FROM snapshots) GROUP BY h
"""


@query("time_of_day", SQL_TIME_OF_DAY)
def time_of_day(spark, sf):
    """F26 with both evening ends (22 in features, 21 in serving), per hour."""
    s = event_times(spark, sf)
    return (s.groupBy("publish_hour").agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"time_of_day_features": TM.time_of_day("publish_hour", 22),
                          "time_of_day_serving": TM.time_of_day("publish_hour", 21)}))


SQL_DELAY = with_views("snapshots") + f"""
SELECT {_case_delay(_H)} AS trending_delay, count(*) AS n FROM snapshots GROUP BY 1
"""


@query("delay_bucket", SQL_DELAY)
def delay_bucket(spark, sf):
    """snapshots per trending-delay bucket."""
    s = A.snapshots(spark, sf).withColumn(
        "trending_delay", TM.delay_category(TM.hours_between("publish_time", "fetch_time")))
    return s.groupBy("trending_delay").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------------
SQL_DURATION_BUCKETS = with_views("parts") + f"""
SELECT video_id, duration_seconds, duration_seconds / 60 AS duration_minutes,
       {_case_duration('duration_seconds')} AS duration_category,
       """ + ",\n       ".join(
    f"CAST({_case_duration('duration_seconds')} = '{lab}' AS INTEGER) AS duration_{lab}"
    for lab in [b[1] for b in S.DURATION_CATEGORY_BOUNDS] + [S.DURATION_CATEGORY_ELSE]) + f""",
       {_case_bins('duration_seconds / 60', S.DURATION_MINUTE_EDGES, S.DURATION_MINUTE_LABELS)} AS duration_group,
       round(ln(1 + duration_seconds), 9) AS duration_log
FROM parts
"""


@query("duration_buckets", SQL_DURATION_BUCKETS)
def duration_buckets(spark, sf):
    """F11-F13 + F15: duration minutes, category (left-closed), dummies, minute bins (right-closed)."""
    p = A.parts(spark, sf)
    labels = [b[1] for b in S.DURATION_CATEGORY_BOUNDS] + [S.DURATION_CATEGORY_ELSE]
    p = p.withColumn("duration_category", N.duration_category("duration_seconds"))
    out = p.select(
        "video_id", "duration_seconds", N.duration_minutes("duration_seconds").alias("duration_minutes"),
        "duration_category",
        *[c.alias(n) for n, c in N.one_hot("duration_category", labels, "duration").items()],
        N.bin_right_closed(N.duration_minutes("duration_seconds"), S.DURATION_MINUTE_EDGES,
                           S.DURATION_MINUTE_LABELS).alias("duration_group"),
        N.log1p("duration_seconds").alias("duration_log"))
    return rounded(out, 9, only=["duration_log"])


SQL_BEST_DURATION = with_views("parts") + f"""
SELECT category_name, duration_group, round(avg_engagement, 6) AS avg_engagement FROM (
  SELECT category_name, duration_group, avg(engagement_score) AS avg_engagement,
         row_number() OVER (PARTITION BY category_name ORDER BY avg(engagement_score) DESC,
                            min(bucket_no)) AS rn
  FROM (SELECT category_name, engagement_score,
               {_case_bins('duration_seconds / 60', S.DURATION_MINUTE_EDGES, S.DURATION_MINUTE_LABELS)}
                 AS duration_group,
               list_position({S.DURATION_MINUTE_LABELS!r},
                 {_case_bins('duration_seconds / 60', S.DURATION_MINUTE_EDGES, S.DURATION_MINUTE_LABELS)})
                 AS bucket_no
        FROM parts WHERE duration_seconds / 60 <= 60)
  WHERE duration_group IS NOT NULL GROUP BY category_name, duration_group)
WHERE rn = 1
"""


@query("best_duration_by_category", SQL_BEST_DURATION)
def best_duration_by_category(spark, sf):
    """A23 + W2: best minute bucket per category (price stands for engagement on this table)."""
    return rounded(AG.best_bucket_by_group(A.parts(spark, sf)), 6)


_ISO_SQL = ("'P' || CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS VARCHAR) || 'D' ELSE '' END || 'T' || "
            "CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) || 'H' ELSE '' END || "
            "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' || CAST(l_linenumber * 7 AS VARCHAR) || 'S'")
SQL_ISO = f"""
SELECT l_orderkey, l_linenumber, duration_text,
       CAST(coalesce(TRY_CAST(regexp_extract(duration_text, '(\\d+)H', 1) AS BIGINT), 0) * 3600
          + coalesce(TRY_CAST(regexp_extract(duration_text, '(\\d+)M', 1) AS BIGINT), 0) * 60
          + coalesce(TRY_CAST(regexp_extract(duration_text, '(\\d+)S', 1) AS BIGINT), 0) AS BIGINT) AS duration_seconds
FROM (SELECT l_orderkey, l_linenumber, {_ISO_SQL} AS duration_text FROM lineitem)
"""


@query("iso_duration_parse", SQL_ISO)
def iso_duration_parse(spark, sf):
    """ISO-8601 text derived from every line item -> seconds (day part ignored)."""
    li = spread(read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                                                    "l_linestatus"]))  # regex work per row
    ln = F.col("l_linenumber").cast("string")
    text = F.concat(
        F.lit("P"), F.when(F.col("l_linestatus") == "F", F.concat(ln, F.lit("D"))).otherwise(F.lit("")),
        F.lit("T"), F.when(F.col("l_returnflag") == "R", F.concat(ln, F.lit("H"))).otherwise(F.lit("")),
        F.col("l_quantity").cast("bigint").cast("string"), F.lit("M"),
        (F.col("l_linenumber") * 7).cast("string"), F.lit("S"))
    li = li.select("l_orderkey", "l_linenumber", text.alias("duration_text"))
    return li.withColumn("duration_seconds", TM.iso_duration_seconds("duration_text"))


# ---------------------------------------------------------------------------------------------
SQL_CHANNEL_WINDOWS = with_views("ve") + """
SELECT video_id, channel_id, engagement_score, channel_video_count,
       round(channel_avg_engagement, 6) AS channel_avg_engagement,
       round(engagement_score / coalesce(channel_avg_engagement, 1.0), 6) AS relative_engagement
FROM (SELECT video_id, channel_id, engagement_score,
             count(*) OVER (PARTITION BY channel_id) AS channel_video_count,
             avg(engagement_score) OVER (PARTITION BY channel_id) AS channel_avg_engagement
      FROM ve)
"""


@query("channel_windows", SQL_CHANNEL_WINDOWS)
def channel_windows(spark, sf):
    """W1 + J2 + J3 + F8: channel count / mean mapped to rows (groupBy + join, skew-safe)."""
    from trendspark.plans.features import channel_features
    out = channel_features(ve(spark, sf).select("video_id", "channel_id", "engagement_score"))
    return rounded(out, 6, only=["channel_avg_engagement", "relative_engagement"])


SQL_CHANNEL_WINDOWS_ANY_SIZE = with_views("ve") + """
SELECT video_id, channel_id, engagement_score, count(*) OVER w AS channel_video_count,
       round(avg(engagement_score) OVER w, 6) AS channel_avg_engagement,
       round(engagement_score / coalesce(avg(engagement_score) OVER w, 1.0), 6) AS relative_engagement
FROM ve WINDOW w AS (PARTITION BY channel_id)
"""


@query("channel_windows_any_size", SQL_CHANNEL_WINDOWS_ANY_SIZE)
def channel_windows_any_size(spark, sf):
    """W1 + J2 + J3 + F8 at every table size: the mean doesn't depend on the number of rows."""
    from trendspark.plans.features import channel_features
    out = channel_features(ve(spark, sf).select("video_id", "channel_id", "engagement_score"))
    return rounded(out, 6, only=["channel_avg_engagement", "relative_engagement"])


_Z_COLS = ["views", "likes", "comments", "duration_seconds", "tag_count", "like_view_ratio",
           "comment_view_ratio", "engagement_score"]
SQL_ZSCORE = with_views("ve") + "SELECT video_id, " + ", ".join(
    f"round(ln(1 + {c}), 9) AS {c}_log" for c in ["views", "likes", "comments", "duration_seconds"]) + ", " + ", ".join(
    f"round(CASE WHEN coalesce((SELECT stddev_samp({c}) FROM ve), 0) > 0 THEN ({c} - (SELECT avg({c}) FROM ve))"
    f" / (SELECT stddev_samp({c}) FROM ve) ELSE 0.0 END, 9) AS {c}_norm" for c in _Z_COLS) + " FROM ve"


@query("zscore_log_features", SQL_ZSCORE)
def zscore_log_features(spark, sf):
    """F2 + F9 + A18 + J10: log1p counts and whole-table z-scores."""
    v = ve(spark, sf)
    v = v.withColumns({f"{c}_log": N.log1p(c) for c in ["views", "likes", "comments", "duration_seconds"]})
    v = ST.with_zscores(v, _Z_COLS)
    cols = [f"{c}_log" for c in ["views", "likes", "comments", "duration_seconds"]] + [f"{c}_norm" for c in _Z_COLS]
    return rounded(v.select("video_id", *cols), 9)


_REGION_COLS = {r: "region_" + r.replace(" ", "_") for r in REGION_VALUES}
_DUR_LABELS = [b[1] for b in S.DURATION_CATEGORY_BOUNDS] + [S.DURATION_CATEGORY_ELSE]
SQL_ONE_HOT = with_views("videos") + "SELECT video_id, " + ", ".join(
    f"CASE WHEN region = '{r}' THEN 1 ELSE 0 END AS {n}" for r, n in _REGION_COLS.items()) + ", " + ", ".join(
    f"CASE WHEN {_case_duration('duration_seconds')} = '{lab}' THEN 1 ELSE 0 END AS duration_{lab}"
    for lab in _DUR_LABELS) + ", " + ", ".join(
    f"CASE WHEN category_id = '{k}' THEN 1 ELSE 0 END AS category_{k}" for k in S.CATEGORY_NAMES) + " FROM videos"


@query("one_hot", SQL_ONE_HOT)
def one_hot(spark, sf):
    """fixed-vocabulary one-hot of region (D1: region kept), duration category, category id."""
    v = A.videos(spark, sf).withColumn("duration_category", N.duration_category("duration_seconds"))
    cols = {}
    for r, n in _REGION_COLS.items():
        cols[n] = F.coalesce((F.col("region") == r).cast("int"), F.lit(0))
    cols.update(N.one_hot("duration_category", _DUR_LABELS, "duration"))
    cols.update(N.one_hot("category_id", list(S.CATEGORY_NAMES), "category"))
    return v.select("video_id", *[c.alias(n) for n, c in cols.items()])


# ---------------------------------------------------------------------------------------------
_VIRALITY_SQL = ("views / greatest(hours_since_published, 1.0 / 60) * ln(1 + views) "
                 "/ sqrt(greatest(hours_since_published, 1.0))")
SQL_TARGETS = with_views("vf") + f"""
SELECT video_id, engagement_score,
       CAST(engagement_score >= (SELECT quantile_cont(engagement_score, 0.75) FROM vf) AS INTEGER) AS is_highly_engaging,
       views_per_hour, round(ln(1 + views_per_hour), 9) AS views_per_hour_log, like_view_ratio,
       CAST(round({_VIRALITY_SQL}, 9) >= (SELECT quantile_cont(round({_VIRALITY_SQL}, 9), 0.75) FROM vf) AS INTEGER)
         AS is_viral
FROM vf
"""


@query("quartile_targets", SQL_TARGETS)
def quartile_targets(spark, sf):
    """M1 + A17: targets; top-quartile flags use exact whole-table quantiles (ties included)."""
    v = vf(spark, sf).withColumn(
        "virality_score", F.round(N.virality("views", "hours_since_published"), 9))
    t = TG.create_targets(v)
    return rounded(t.select("video_id", "engagement_score", "is_highly_engaging", "views_per_hour",
                            "views_per_hour_log", "like_view_ratio", "is_viral"), 9, only=["views_per_hour_log"])


SQL_TARGET_BALANCE = with_views("vf") + """
SELECT count(*) AS n, CAST(sum(CASE WHEN engagement_score >= q THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       round(avg(CASE WHEN engagement_score >= q THEN 1 ELSE 0 END) * 100, 6) AS positive_pct
FROM vf, (SELECT quantile_cont(engagement_score, 0.75) AS q FROM vf)
"""


@query("target_balance", SQL_TARGET_BALANCE)
def target_balance(spark, sf):
    """Class balance of the top-quartile target (>= 25 % by construction, ties included)."""
    t = TG.create_targets(ve(spark, sf), targets=["is_highly_engaging"])
    return rounded(t.agg(F.count(F.lit(1)).alias("n"),
                         F.sum("is_highly_engaging").cast("bigint").alias("positives"),
                         (F.avg("is_highly_engaging") * 100).alias("positive_pct")), 6)


_QC_METRICS = ["duration_seconds", "tag_count", "like_view_ratio", "comment_view_ratio", "likes"]
SQL_QUARTILE_COMPARE = with_views("vf") + """
SELECT metric, round(top_videos, 6) AS top_videos, round(bottom_videos, 6) AS bottom_videos,
       round((top_videos - bottom_videos) / bottom_videos * 100, 1) AS difference
FROM (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, avg(CASE WHEN views_per_hour >= q75 THEN {m} END) AS top_videos, "
    f"avg(CASE WHEN views_per_hour <= q25 THEN {m} END) AS bottom_videos FROM vf, "
    f"(SELECT quantile_cont(views_per_hour, 0.75) AS q75, quantile_cont(views_per_hour, 0.25) AS q25 FROM vf)"
    for m in _QC_METRICS) + ")"


@query("quartile_compare", SQL_QUARTILE_COMPARE)
def quartile_compare(spark, sf):
    """A16 + P5: top (>= q75) vs bottom (<= q25) views-per-hour quartile means, pct difference."""
    out = AG.quartile_compare(vf(spark, sf), "views_per_hour", _QC_METRICS)
    return rounded(out, 6, only=["top_videos", "bottom_videos"])


_GM = ["views", "likes", "comments", "like_view_ratio", "comment_view_ratio", "engagement_score"]
SQL_GLOBAL_MEANS = with_views("ve") + "SELECT count(video_id) AS video_count, " + ", ".join(
    f"round(avg({m}), 6) AS avg_{m}" for m in _GM) + ", round(avg(duration_seconds) / 60, 6) AS avg_duration_minutes FROM ve"


@query("global_means", SQL_GLOBAL_MEANS)
def global_means(spark, sf):
    """Count and means in one aggregate."""
    out = AG.global_means(ve(spark, sf), _GM + ["duration_seconds"])
    out = out.withColumn("avg_duration_minutes", F.col("avg_duration_seconds") / 60).drop("avg_duration_seconds")
    return rounded(out, 6)


_CORR = ["views", "likes", "comments", "duration_seconds", "tag_count", "engagement_score", "like_view_ratio",
         "comment_view_ratio"]
SQL_CORR = with_views("ve") + " UNION ALL ".join(
    (f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS corr FROM ve" if a == b else
     f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 "
     f"THEN round(corr({a}, {b}), 6) END AS corr FROM ve")
    for a in _CORR for b in _CORR)


@query("correlation_matrix", SQL_CORR)
def correlation_matrix(spark, sf):
    """Pearson matrix over eight columns in one aggregate pass."""
    return rounded(ST.correlation_matrix(ve(spark, sf), _CORR), 6)


_DESC = ["views", "likes", "engagement_score"]
SQL_DESCRIBE = with_views("ve") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS stat, round(CAST({e} AS DOUBLE), 6) AS value FROM ve"
    for c in _DESC for s, e in [
        ("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"),
        ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"),
        ("75%", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})")])


@query("describe_all", SQL_DESCRIBE)
def describe_all(spark, sf):
    """A12 (numeric): count, mean, sd, min, quartiles (exact), max."""
    return rounded(ST.describe_numeric(ve(spark, sf), _DESC), 6)


SQL_DESCRIBE_CAT = with_views("videos") + """
SELECT CAST(sum(freq) AS BIGINT) AS count, count(*) AS unique, arg_min(channel_title, (-freq, channel_title)) AS top,
       max(freq) AS freq
FROM (SELECT channel_title, count(*) AS freq FROM videos WHERE channel_title IS NOT NULL GROUP BY 1)
"""


@query("describe_categorical", SQL_DESCRIBE_CAT)
def describe_categorical(spark, sf):
    """A12 (object): count, unique, top, freq of the channel column."""
    return ST.describe_categorical(A.videos(spark, sf), "channel_title")


SQL_HIST = with_views("ve") + """
SELECT bin, count(*) AS count, round(lo + w * bin / 50, 9) AS bin_lo, round(lo + w * (bin + 1) / 50, 9) AS bin_hi
FROM (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((engagement_score - lo) / w * 50), 49) END AS INTEGER)
             AS bin, lo, w
      FROM ve, (SELECT min(engagement_score) AS lo, max(engagement_score) - min(engagement_score) AS w FROM ve)
      WHERE engagement_score IS NOT NULL)
GROUP BY bin, lo, w
"""


@query("hist_bins", SQL_HIST)
def hist_bins(spark, sf):
    """50 equal-width engagement bins over [min, max], last bin closed."""
    return rounded(ST.histogram(ve(spark, sf), "engagement_score", 50), 9)


SQL_HIST_MIN = with_views("parts") + """
SELECT bin, count(*) AS count, round(0.0 + 60.0 * bin / 30, 9) AS bin_lo, round(0.0 + 60.0 * (bin + 1) / 30, 9) AS bin_hi
FROM (SELECT CAST(least(floor((duration_seconds / 60 - 0.0) / 60.0 * 30), 29) AS INTEGER) AS bin
      FROM parts WHERE duration_seconds < 3600 AND duration_seconds / 60 >= 0.0 AND duration_seconds / 60 <= 60.0)
GROUP BY bin
"""


@query("hist_minutes", SQL_HIST_MIN)
def hist_minutes(spark, sf):
    """P3 + A19: 30 minute-bins of durations below one hour."""
    p = P.filter_range(A.parts(spark, sf), "duration_seconds", hi=3600)
    p = p.withColumn("minutes", N.duration_minutes("duration_seconds"))
    return rounded(ST.histogram(p, "minutes", 30, lo=0.0, hi=60.0).select("bin", "count", "bin_lo", "bin_hi"), 9)


SQL_BOX = with_views("parts") + """, p AS (SELECT category_name, duration_seconds / 60 AS m FROM parts),
q AS (SELECT category_name, count(m) AS n, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median,
             quantile_cont(m, 0.75) AS q3 FROM p GROUP BY 1)
SELECT q.category_name, n, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
       round(q3 - q1, 9) AS iqr,
       round(min(CASE WHEN m >= q1 - 1.5 * (q3 - q1) THEN m END), 9) AS whisker_lo,
       round(max(CASE WHEN m <= q3 + 1.5 * (q3 - q1) THEN m END), 9) AS whisker_hi,
       CAST(sum(CASE WHEN m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM p JOIN q USING (category_name) GROUP BY q.category_name, n, q1, median, q3
"""


@query("box_numbers", SQL_BOX)
def box_numbers(spark, sf):
    """Duration-minute box numbers by category (quartiles exact)."""
    p = A.parts(spark, sf).withColumn("m", N.duration_minutes("duration_seconds"))
    return rounded(ST.box_numbers(p, "category_name", "m"), 9)


SQL_MEAN_CI = with_views("snapshots") + """
SELECT publish_hour, n, round(mean, 4) AS mean, round(sd, 4) AS sd,
       round(mean - 1.96 * sd / sqrt(n), 4) AS ci_lo, round(mean + 1.96 * sd / sqrt(n), 4) AS ci_hi
FROM (SELECT CAST(hour(fetch_time) AS INTEGER) AS publish_hour, count(views) AS n, avg(views) AS mean,
             stddev_samp(views) AS sd FROM snapshots GROUP BY 1)
"""


@query("mean_ci_by_hour", SQL_MEAN_CI)
def mean_ci_by_hour(spark, sf):
    """Hourly mean value with a normal 95 % band."""
    return rounded(ST.mean_ci(event_times(spark, sf), "publish_hour", "views"), 4)


# ---------------------------------------------------------------------------------------------
SQL_CHART = with_views("ve") + """
SELECT video_id, category_name, engagement_score, round(log10(views), 9) AS log_views,
       round(log10(likes), 9) AS log_likes, round(log10(comments), 9) AS log_comments
FROM ve WHERE views > 0 AND likes > 0 AND comments > 0
"""


@query("chart_points", SQL_CHART)
def chart_points(spark, sf):
    """P15 + P16: log-axis points where all three counts are positive."""
    v = P.ensure_engagement(ve(spark, sf))
    return rounded(P.chart_points(v, ["views", "likes", "comments"], ["video_id", "category_name",
                                                                    "engagement_score"]),
                   9, only=["log_views", "log_likes", "log_comments"])


SQL_HASH_SPLIT = with_views("videos") + """
SELECT video_id, channel_id,
       CAST((('0x' || substr(md5(CAST(channel_id AS VARCHAR)), 1, 8))::BIGINT % 100) < 20 AS INTEGER) AS is_test
FROM videos
"""


@query("hash_split", SQL_HASH_SPLIT)
def hash_split(spark, sf):
    """M2 (D14): 80/20 split by a hash of the group key (channel), reproducible in SQL."""
    from trendspark.ml.split import hash_split_flag
    v = A.videos(spark, sf).select("video_id", "channel_id")
    return v.withColumn("is_test", hash_split_flag("channel_id", 0.2).cast("int"))


SQL_SAMPLE = with_views("videos") + """
SELECT video_id, views FROM videos ORDER BY md5(CAST(video_id AS VARCHAR) || ':42'), video_id LIMIT 500
"""


@query("deterministic_sample", SQL_SAMPLE)
def deterministic_sample(spark, sf):
    """Reproducible uniform sample of 500 rows (seeded hash order; the limit is the feature)."""
    from trendspark.ml.split import hash_sample
    return hash_sample(A.videos(spark, sf).select("video_id", "views"), 500, "video_id", seed=42)


SQL_HIST_BY_CATEGORY = with_views("ve") + """
SELECT category_name, bin, count(*) AS count, round(lo + w * bin / 50, 9) AS bin_lo,
       round(lo + w * (bin + 1) / 50, 9) AS bin_hi
FROM (SELECT v.category_name, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((engagement_score - lo) / w * 50), 49) END
             AS INTEGER) AS bin, lo, w
      FROM ve v JOIN (SELECT category_name, min(engagement_score) AS lo,
                             max(engagement_score) - min(engagement_score) AS w FROM ve GROUP BY 1) b
        USING (category_name)
      WHERE engagement_score IS NOT NULL)
GROUP BY category_name, bin, lo, w
"""


@query("hist_engagement_by_category", SQL_HIST_BY_CATEGORY)
def hist_engagement_by_category(spark, sf):
    """50 engagement bins per category over each category's own range."""
    return rounded(ST.histogram_by_group(ve(spark, sf), "category_name", "engagement_score", 50), 9,
                   only=["bin_lo", "bin_hi"])
