"""The progression operator gives the same table on a stream as in batch (T4)."""

from pyspark.sql import functions as F

from trendspark.sources import adapters as A
from trendspark.streaming import ingest as I
from trendspark.streaming import progression as PG

from conftest import SF_SMALL

KEY = ["video_id", "category_id", "region"]


def test_stream_equals_batch(spark):
    batch = PG.progress(A.snapshots(spark, SF_SMALL), KEY)
    state = PG.snapshot_state(I.snapshot_stream(spark, SF_SMALL), KEY)
    stream = PG.progression_from_state(I.run_to_table(spark, state, "test-progression"), KEY)
    cols = KEY + ["snapshot_count", "first_views", "last_views", "view_growth_per_hour"]
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    s = sorted(tuple(r) for r in stream.select(*cols).collect())
    assert b == s and len(b) > 0


def test_growth_null_when_no_time_passes(spark):
    df = spark.createDataFrame(
        [(1, "v", "c", "r", "2024-01-01 00:00:00", 10.0, 1, 1), (2, "v", "c", "r", "2024-01-01 00:00:00", 5.0, 1, 1),
         (3, "w", "c", "r", "2024-01-01 00:00:00", 1.0, 1, 1)],
        "snapshot_id int, video_id string, category_id string, region string, t string, views double, "
        "likes int, comments int").withColumn("fetch_time", F.to_timestamp("t"))
    out = PG.progress(df, KEY).collect()
    assert len(out) == 1 and out[0]["view_growth_per_hour"] is None  # one-snapshot key 'w' excluded


def test_decreasing_and_out_of_order(spark):
    df = spark.createDataFrame(
        [(2, "v", "c", "r", "2024-01-01 02:00:00", 50.0, 1, 1), (1, "v", "c", "r", "2024-01-01 00:00:00", 100.0, 1, 1)],
        "snapshot_id int, video_id string, category_id string, region string, t string, views double, "
        "likes int, comments int").withColumn("fetch_time", F.to_timestamp("t"))
    r = PG.progress(df, KEY).first()
    assert r["first_views"] == 100.0 and r["last_views"] == 50.0 and r["view_growth_per_hour"] == -25.0


def test_restart_from_checkpoint_is_idempotent(spark):
    """A second run on the same checkpoint finds no new input: the table is unchanged (a lost
    driver or executor costs a re-run, not duplicated or missing rows)."""
    from trendspark.session import scratch_path
    path, ckpt = scratch_path(spark, "restart-table"), scratch_path(spark, "restart-ckpt")
    first = I.run_to_table(spark, I.snapshot_stream(spark, SF_SMALL), "restart", "append", path, ckpt).count()
    again = I.run_to_table(spark, I.snapshot_stream(spark, SF_SMALL), "restart", "append", path, ckpt).count()
    batch = A.snapshots(spark, SF_SMALL).count()
    assert first == again == batch


def test_stream_sessions_hold_those_still_open(spark):
    import __spark_entry__ as E
    streamed, batch = (E.queries()[k](spark, SF_SMALL).select("video_id", "category_id", "region", "session_start", "session_end", "snapshots") for k in ("stream_sessions", "sessions"))
    last = batch.agg(F.max("session_end")).first()[0]
    assert streamed.where(F.col("session_end") == F.lit(last)).count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
