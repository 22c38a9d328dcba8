"""Queries of dead letters (T5), CSV by header (S1), bucketed upsert (S11), quantiles of many groups (A20), the
bootstrap band (A21), sweeps (M18) and the variants of single operators (O1, F18, P7, P8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.catalog.common import REGION_VALUES, event_times, ve, vf
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import numeric as N
from trendspark.functions import scoring as SC
from trendspark.ml import feature_table as FT
from trendspark.ml import gram as GR
from trendspark.operators import bootstrap as BS
from trendspark.operators import filters as P
from trendspark.operators import stats as ST
from trendspark.session import materialize, scratch_path
from trendspark.sources import adapters as A
from trendspark.sources import csv_headers as CH
from trendspark.sources import files as SRC
from trendspark.sources import upsert as UP
from trendspark.streaming import deadletter as DL

SQL_DEAD_LETTERS = with_views("snapshots") + """
SELECT CASE WHEN bad IS NULL THEN 'good' ELSE 'bad' END AS outcome, CASE WHEN bad IS NULL THEN region END AS region, bad AS reason,
       count(*) AS n, CASE WHEN bad IS NULL THEN CAST(sum(views) AS BIGINT) ELSE 0 END AS total_views
FROM (SELECT *, CASE snapshot_id % 50 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'missing video_id' WHEN 2 THEN 'unknown region' END AS bad FROM snapshots)
GROUP BY 2, 3, bad
"""
RECORD = T.StructType([T.StructField("snapshot_id", T.LongType()), T.StructField("video_id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("views", T.LongType())])


@query("stream_dead_letters", SQL_DEAD_LETTERS)
def stream_dead_letters(spark, sf):
    """T5: snapshots as JSON lines, of which some are cut off, lack a field or name no known region, drained as a
    stream; every line is in exactly one of the two tables."""
    s = A.snapshots(spark, sf).select("snapshot_id", "video_id", "region", "views")
    kind = F.col("snapshot_id") % 50
    record = F.to_json(F.struct("snapshot_id", F.when(kind != 1, F.col("video_id")).alias("video_id"), F.when(kind == 2, F.lit("ATLANTIS")).otherwise(F.col("region")).alias("region"), "views"))
    path = scratch_path(spark, "json-lines")
    s.select("region", F.when(kind == 0, F.substring(record, 1, 14)).otherwise(record).alias("value")).write.partitionBy("region").text(path)
    letters = DL.DeadLetters(scratch_path(spark, "dead-letters"), RECORD, ("snapshot_id", "video_id"), tuple(REGION_VALUES))
    letters.drain(DL.text_stream(spark, path), scratch_path(spark, "dead-letters-checkpoint"))
    good = letters.good(spark).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("total_views"))
    bad = letters.bad(spark).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    return good.select(F.lit("good").alias("outcome"), "region", none.cast("string").alias("reason"), "n", "total_views").unionByName(
        bad.select(F.lit("bad").alias("outcome"), none.cast("string").alias("region"), "reason", "n", F.lit(0).cast("long").alias("total_views")))


SQL_CSV_BY_HEADER = with_views("ve") + """
SELECT video_id, region, CASE WHEN video_id % 3 <> 1 THEN channel_title END AS channel_title, CASE WHEN video_id % 3 <> 2 THEN CAST(views AS DOUBLE) END AS views, likes,
       CASE WHEN video_id % 3 = 0 THEN round(engagement_score, 6) END AS engagement_score
FROM ve
"""


@query("csv_by_header", SQL_CSV_BY_HEADER)
def csv_by_header(spark, sf):
    """Three sets of CSV files with other columns in other orders, scanned as one table."""
    v = materialize(spark, ve(spark, sf).select("video_id", "region", "channel_title", "views", "likes", "engagement_score"), "csv-source")
    path = scratch_path(spark, "csv-files")
    for k, names in enumerate((["video_id", "region", "channel_title", "views", "likes", "engagement_score"], ["likes", "views", "region", "video_id"], ["region", "likes", "video_id", "channel_title"])):
        v.where(F.col("video_id") % 3 == k).select(*names).write.option("header", True).csv(f"{path}/set={k}")
    good, _ = CH.read_csv_by_header(spark, f"{path}/*", v.schema)
    return rounded(good.withColumn("views", F.col("views").cast("double")), 6)


SQL_UPSERT_BUCKETS = with_views("snapshots") + """
SELECT video_id, category_id, region, snapshot_id, fetch_time, views FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, category_id, region ORDER BY fetch_time DESC, snapshot_id DESC) AS rn FROM snapshots)
WHERE rn = 1
"""


@query("upsert_buckets", SQL_UPSERT_BUCKETS)
def upsert_buckets(spark, sf):
    """Pulls merged one after the other into a bucketed table; the second one is sent twice."""
    s = A.snapshots(spark, sf).select("video_id", "category_id", "region", "snapshot_id", "fetch_time", "views")
    path, key = scratch_path(spark, "upsert-buckets"), ["video_id", "category_id", "region"]
    for batch, part in (("a", s.where(F.dayofmonth("fetch_time") < 20)), ("b", s.where(F.dayofmonth("fetch_time") >= 10)), ("b", s.where(F.dayofmonth("fetch_time") >= 10))):
        UP.upsert_into(part.withColumn("newest", F.struct("fetch_time", "snapshot_id")), path, key, "newest", batch, buckets=8)
    return UP.read_upserted(spark, path).select(*key, "snapshot_id", "fetch_time", "views")


SQL_BOX_BY_CHANNEL = with_views("ve") + """
, q AS (SELECT channel_id, count(engagement_score) AS n, quantile_cont(engagement_score, 0.25) AS q1, quantile_cont(engagement_score, 0.5) AS median,
               quantile_cont(engagement_score, 0.75) AS q3 FROM ve GROUP BY 1)
SELECT channel_id, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       round(any_value(q3 - q1), 6) AS iqr,
       round(min(engagement_score) FILTER (engagement_score >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round(max(engagement_score) FILTER (engagement_score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
       count(*) FILTER (engagement_score < q1 - 1.5 * (q3 - q1) OR engagement_score > q3 + 1.5 * (q3 - q1)) AS outliers
FROM ve JOIN q USING (channel_id) GROUP BY 1
"""


@query("box_numbers_by_channel", SQL_BOX_BY_CHANNEL)
def box_numbers_by_channel(spark, sf):
    """Box numbers of engagement for each channel, as many groups as a tenth of the rows."""
    return rounded(ST.box_numbers(ve(spark, sf).select("channel_id", "engagement_score"), "channel_id", "engagement_score"), 6)


_LIMITS = BS.poisson_limits()
_WEIGHT_SQL = " + ".join(f"CASE WHEN u >= {limit} THEN 1 ELSE 0 END" for limit in _LIMITS)
SQL_BOOTSTRAP = with_views("snapshots") + f"""
, r AS (SELECT CAST(hour(fetch_time) AS INTEGER) AS publish_hour, CAST(views AS DOUBLE) AS x, CAST(snapshot_id AS VARCHAR) AS k FROM snapshots WHERE views IS NOT NULL),
d AS (SELECT publish_hour, x, part * 4 + i AS rep, CAST('0x' || substr(md5(k || ':42:' || part), 8 * i + 1, 8) AS BIGINT) AS u
      FROM r, (SELECT unnest(range(0, 10)) AS part), (SELECT unnest(range(0, 4)) AS i)),
m AS (SELECT publish_hour, rep, sum(w * x) / nullif(sum(w), 0) AS m FROM (SELECT *, {_WEIGHT_SQL} AS w FROM d) GROUP BY 1, 2)
SELECT publish_hour, n, round(mean, 2) AS mean, round(ci_lo, 2) AS ci_lo, round(ci_hi, 2) AS ci_hi
FROM (SELECT publish_hour, count(*) AS n, avg(x) AS mean FROM r GROUP BY 1)
JOIN (SELECT publish_hour, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM m GROUP BY 1) USING (publish_hour)
"""


@query("mean_bootstrap_by_hour", SQL_BOOTSTRAP)
def mean_bootstrap_by_hour(spark, sf):
    """Hourly mean with the percentile band of 40 bootstrap replicates, hash-seeded."""
    e = event_times(spark, sf).select("publish_hour", "views", "snapshot_id")
    return rounded(BS.bootstrap_band(e, "publish_hour", "views", "snapshot_id", replicates=40), 2)


# --- variants of single operators -----------------------------------------------------------------
SQL_TRENDING_POPULAR = with_views("vf") + """
SELECT video_id, region, views
FROM (SELECT *, ln(1 + views) * engagement_score AS popularity_score FROM vf) ORDER BY round(popularity_score, 9) DESC, video_id LIMIT 1000
"""


@query("trending_by_popularity", SQL_TRENDING_POPULAR)
def trending_by_popularity(spark, sf):
    """O1: the trending list by popularity_score where the rows have one (top 1000)."""
    v = vf(spark, sf).withColumn("popularity_score", F.round(F.log1p("views") * F.col("engagement_score"), 9))
    return P.trending_order(v).select("video_id", "region", "views")


SQL_VIEWS_FROM_RATE = with_views("vf") + "SELECT video_id, CAST(trunc(views_per_hour * 48) AS BIGINT) AS views_estimate FROM vf"


@query("views_from_rate", SQL_VIEWS_FROM_RATE)
def views_from_rate(spark, sf):
    """F18 (model form): views over 48 hours from the rate, for every video."""
    return vf(spark, sf).select("video_id", SC.views_from_rate("views_per_hour").alias("views_estimate"))


SQL_NUMERIC_COLUMNS = with_views("videos") + "SELECT views, likes, comments, duration_seconds, tag_count FROM videos"


@query("numeric_columns", SQL_NUMERIC_COLUMNS)
def numeric_columns(spark, sf):
    """P7 + P8: identifiers dropped (absent ones ignored), then the numeric columns only."""
    return P.numeric_only(P.drop_if_present(A.videos(spark, sf), ["video_id", "channel_id", "thumbnail_url"]))


SWEEPS = {
    "duration_seconds": [60, 180, 300, 600, 900, 1200, 1800, 2700, 3600], "publish_hour": list(range(24)), "publish_weekday": list(range(7)),
    "category_id": ["1", "10", "17", "20", "22", "23", "24", "25", "28"],
}


@query("ml_sensitivity_sweeps")
def ml_sensitivity_sweeps(spark, sf):
    """M18 + J8: every request with its duration, hour, weekday or category set to each value of a sweep, scored by a ridge
    model of the views per hour over the wide features."""
    from trendspark.catalog.q_train import _training_table
    table, features, held = _training_table(spark, sf)
    own = [f for f in features if f not in held["views_per_hour_log"]]
    train = table.where(~F.col("is_test"))
    parts = GR.fold_sums(train, own, "views_per_hour_log", F.lit(0), 1)
    w, b = parts[0].ridge(1.0)
    model = GR.RidgeModel(own, w.tolist(), b)
    # written once: the fit reads them several times, and each sweep all requests (a title stays as it is in all of them)
    rows = materialize(spark, FT.row_features(A.wide_videos(spark, sf), ["video_id"]).select("category_id", "duration_bin", "_channel", *[c for c in FT.NORMALIZED if not c.startswith("channel_")]), "sweep-rows")
    fitted = FT.fit(rows, scratch_path(spark, "sweep-parameters"))
    asked = A.requests(spark, sf).select("doc_id", "title", "category_id", "duration_seconds", "publish_hour", "publish_weekday", "publish_month", F.size("tags").alias("tag_count"))
    asked = materialize(spark, FT.with_titles(asked).drop("title"), "sweep-requests")
    out = None
    for name, values in SWEEPS.items():
        varied = asked.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]))).withColumn("value", F.col(name).cast("string"))
        wide = fitted.transform(FT.row_features(varied, ["doc_id", "value"], titled=True), ["doc_id", "value"])
        scored = wide.select("value", *[F.col(c).alias(f"f_{c}") for c in fitted.columns]).select("value", model.column().alias("p"))
        means = scored.groupBy("value").agg(F.avg("p").alias("mean_prediction"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("attribute"), "value", "mean_prediction", "n")
        out = means if out is None else out.unionByName(means)
    return rounded(out, 6)
