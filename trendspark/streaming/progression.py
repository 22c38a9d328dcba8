"""Snapshot progression (T3, T4, W3-W6) - one definition for batch and Structured Streaming.

State is a bounded aggregate per key (count, first and last snapshot as
structs), never a list of rows: ``min``/``max`` of a struct ordered by
(time, tie-break id) are declarative aggregates, so Spark combines them
map-side before the shuffle and keeps one small row per key in the state store.
"More than one snapshot" is decided only on output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions.temporal import hours_between
from trendspark.session import shared_dir

DEFAULT_KEY = ("video_id", "category_id", "region")
DEFAULT_VALUES = ("views", "likes", "comments")
GROWTH_NAMES = {"views": "view_growth_per_hour", "likes": "like_growth_per_hour",
                "comments": "comment_growth_per_hour"}


def snapshot_state(df: DataFrame, key=DEFAULT_KEY, time: str = "fetch_time", tiebreak: str = "snapshot_id",
                   values=DEFAULT_VALUES) -> DataFrame:
    """Per-key bounded state (count, first, last)."""
    point = F.struct(F.col(time).alias("t"), F.col(tiebreak).alias("id"), *[F.col(v).alias(v) for v in values])
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        F.min(point).alias("first"),
        F.max(point).alias("last"),
    )


def progression_from_state(state: DataFrame, key=DEFAULT_KEY, values=DEFAULT_VALUES,
                           min_snapshots: int = 2) -> DataFrame:
    """T4: first/last values, hours between, growth per hour (null when no time passed)."""
    hours = hours_between(F.col("first.t"), F.col("last.t"))
    out = state.where(F.col("snapshot_count") >= min_snapshots).select(
        *key, "snapshot_count",
        F.col("first.t").alias("first_time"), F.col("last.t").alias("last_time"),
        hours.alias("hours_tracked"),
        *[F.col(f"first.{v}").alias(f"first_{v}") for v in values],
        *[F.col(f"last.{v}").alias(f"last_{v}") for v in values])
    growth = {GROWTH_NAMES.get(v, f"{v}_growth_per_hour"):
              F.when(F.col("hours_tracked") > 0,
                     (F.col(f"last_{v}") - F.col(f"first_{v}")) / F.col("hours_tracked"))
              for v in values}
    return out.withColumns(growth)


def progress(df: DataFrame, key=DEFAULT_KEY, time: str = "fetch_time", tiebreak: str = "snapshot_id",
             values=DEFAULT_VALUES, min_snapshots: int = 2) -> DataFrame:
    """T3 + T4 + W4 + W5: works on a batch DataFrame and on a streaming one alike."""
    return progression_from_state(snapshot_state(df, key, time, tiebreak, values), key, values, min_snapshots)


def latest_per_key(df: DataFrame, key, time: str, tiebreak: str) -> DataFrame:
    """Newest row per key (upsert view) - a max over a struct, no window sort."""
    others = [c for c in df.columns if c not in key]
    latest = df.groupBy(*key).agg(F.max(F.struct(F.col(time).alias("_t"), F.col(tiebreak).alias("_id"),
                                                  *[F.col(c) for c in others])).alias("_r"))
    return latest.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def snapshot_deltas(df: DataFrame, key, time: str, tiebreak: str, values=DEFAULT_VALUES,
                    partitions: int | None = None) -> DataFrame:
    """W5 (row form): change since the previous snapshot of the same key and its rate per hour.

    Skew-safe lag: rows are range-partitioned on (key, time, tie-break), so a key holding a
    third of all rows is cut into several pieces; ``lag`` runs inside each (piece, key)
    group (bounded by one range partition), and the first row of a piece takes its
    predecessor from the last row of the previous piece of the same key. Only keys cut by
    a range boundary have pieces to patch, so that table has at most 2 x (partitions - 1)
    rows and is broadcast.
    """
    key = list(key)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, time, tiebreak]
    r = df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id())
    # the piece labels must be the same in both branches below (adaptive execution may read the
    # range exchange with different partition coalescing per consumer): checkpoint them once to
    # the shared folder, which also cuts the lineage
    shared_dir(df.sparkSession)
    r = r.checkpoint(eager=True)
    w = Window.partitionBy("_pid", *key).orderBy(F.col(time), F.col(tiebreak))
    local = r.withColumns({"_prev_t": F.lag(time).over(w), **{f"_prev_{v}": F.lag(v).over(w) for v in values}})
    ends = r.groupBy("_pid", *key).agg(
        F.max(F.struct(F.col(time).alias("t"), F.col(tiebreak).alias("id"),
                       *[F.col(v).alias(v) for v in values])).alias("_last"))
    cut = ends.groupBy(*key).agg(F.count(F.lit(1)).alias("_pieces")).where(F.col("_pieces") > 1).select(*key)
    pieces = ends.join(cut, key, "left_semi")
    pred = (pieces.select("_pid", *key, F.lag("_last").over(Window.partitionBy(*key).orderBy("_pid")).alias("_pred"))
            .where(F.col("_pred").isNotNull()))
    j = local.join(F.broadcast(pred), ["_pid", *key], "left")
    first_of_piece = F.col("_prev_t").isNull() & F.col("_pred").isNotNull()
    prev_t = F.when(first_of_piece, F.col("_pred.t")).otherwise(F.col("_prev_t"))
    out = j.withColumn("hours_since_prev", hours_between(prev_t, F.col(time)))
    for v in values:
        prev_v = F.when(first_of_piece, F.col(f"_pred.{v}")).otherwise(F.col(f"_prev_{v}"))
        out = out.withColumn(f"{v}_delta", (F.col(v) - prev_v).cast("double"))
        out = out.withColumn(f"{v}_delta_per_hour",
                             F.when(F.col("hours_since_prev") > 0, F.col(f"{v}_delta") / F.col("hours_since_prev")))
    return out.drop("_pid", "_prev_t", "_pred", *[f"_prev_{v}" for v in values])


def keys_with_multiple(df: DataFrame, key) -> DataFrame:
    """Rows whose key has more than one snapshot (semi join on a per-key count)."""
    multi = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*key)
    return df.join(multi, list(key), "left_semi")


def trend_days(df: DataFrame, key, time: str) -> DataFrame:
    """Distinct calendar days on which each key was seen (days on trending)."""
    return df.groupBy(*key).agg(F.count_distinct(F.to_date(F.col(time))).alias("days_on_trending"),
                                F.count(F.lit(1)).alias("snapshot_count"))
