"""Online days on trending and progression (T3, W6): blocks of days with state that closes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trendspark.session import scratch_path
from trendspark.streaming import blocks as BL
from trendspark.streaming import ingest as I
from trendspark.streaming import progression as PG

KEY = ["video_id", "region"]
SCHEMA = "snapshot_id bigint, video_id string, region string, fetch_time timestamp, views bigint"
START = dt.datetime(2015, 1, 1)


def _files(spark, files):
    """A folder with one file for each list of rows, in the order in which a stream reads them."""
    path = scratch_path(spark, "block-input")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={k:03d}")
    return path


def _drained(spark, path, output_mode="update", late="1 day", table=None, checkpoint=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    state = BL.block_state(stream, KEY, values=["views"], late=late)
    return I.run_to_table(spark, state, "blocks", output_mode, table, checkpoint)


def _rows(df):
    cols = [*KEY, "snapshot_count", "days_on_trending"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def _random_files(seed, n_files=6, n_rows=300):
    """Files of one year each, in order of time; half the rows belong to one key, some come twice."""
    rng, out, k = random.Random(seed), [], 0
    for f in range(n_files):
        rows = []
        for _ in range(n_rows):
            k += 1
            at = START + dt.timedelta(days=365 * f, seconds=rng.randrange(360 * 86400))
            rows.append((k, "hot" if rng.random() < 0.5 else f"v{rng.randrange(40)}", rng.choice(["a", "b", None]), at, rng.randrange(1000)))
        out.append(rows + rows[:20])
    return out


def _plain(files):
    seen = {}
    for rows in files:
        for _, video, region, at, _ in rows:
            if at is not None:
                seen.setdefault((video, region), []).append(at.date())
    return sorted(((v, r, len(d), len(set(d))) for (v, r), d in seen.items()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_reading_and_state_closes(spark, seed):
    files = _random_files(seed)
    checkpoint = scratch_path(spark, "block-checkpoint")
    blocks = _drained(spark, _files(spark, files), checkpoint=checkpoint)
    assert _rows(BL.merged(blocks, KEY)) == _plain(files)
    held = spark.read.format("statestore").load(checkpoint).count()
    all_blocks = blocks.select(*KEY, "block_start").distinct().count()
    keys = len(_plain(files))
    assert 0 < held <= 2 * keys and held * 5 < all_blocks  # of six years, the blocks of the last days are held


def test_progression_equals_batch(spark):
    files = _random_files(3, n_files=3)
    path = _files(spark, files)
    online = PG.progression_from_state(BL.merged(_drained(spark, path), KEY), KEY, ["views"])
    batch = PG.progress(spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path), KEY, values=["views"])
    assert online.count() > 0
    assert online.select(*batch.columns).exceptAll(batch).count() == 0 and batch.exceptAll(online.select(*batch.columns)).count() == 0


def test_closed_blocks_come_once(spark):
    files = _random_files(4, n_files=3)
    path = _files(spark, files)
    closed, updates = _drained(spark, path, "append"), _drained(spark, path)
    assert closed.groupBy(*KEY, "block_start").count().where("count > 1").count() == 0
    full = updates.groupBy(*KEY, "block_start").agg(F.max("n").alias("n"))
    assert closed.select(*KEY, "block_start", "n").exceptAll(full).count() == 0
    assert 0 < closed.count() < full.count()  # the last blocks are open


def test_odd_rows(spark):
    day = lambda d, h=0: START + dt.timedelta(days=d, hours=h)
    first = [(1, "v", "a", day(0), 1), (1, "v", "a", day(0), 1), (2, "v", "a", day(0, 23), 2), (3, "v", "a", None, 3), (4, None, None, day(1), 4), (5, "w", "a", day(400), 5)]
    late = [(6, "v", "a", day(1), 6), (7, "w", "a", day(399, 1), 7)]
    got = _rows(BL.merged(_drained(spark, _files(spark, [first, [(8, "x", None, day(800), 8)], late])), KEY))
    # the watermark that late rows are held against is that of the batch before: day 399. Row 6 comes after
    # its block closed; the block of row 7 is open until day 460
    assert got == sorted([("v", "a", 3, 1), (None, None, 1, 1), ("w", "a", 2, 2), ("x", None, 1, 1)], key=str)


def test_every_bit_and_versions_in_any_order(spark):
    rows = [(k, "v", "a", START + dt.timedelta(days=k), k) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = BL.block_state(df, KEY, values=["views"], late=None)
    part = BL.block_state(df.where("snapshot_id < 70"), KEY, values=["views"], late=None)
    for versions in (whole.unionByName(part), part.unionByName(whole), part.unionByName(whole).unionByName(whole)):
        assert _rows(BL.merged(versions, KEY)) == [("v", "a", 200, 200)]


def test_days_are_those_of_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.range(0, 130 * 24).select(F.lit(1).alias("snapshot_id"), F.lit("v").alias("video_id"), F.lit("a").alias("region"),
                                                F.timestamp_seconds(F.lit(1_420_070_400) + F.col("id") * 3600).alias("fetch_time"), F.lit(1).alias("views"))
            online = BL.merged(BL.block_state(df, KEY, values=["views"], late=None), KEY).first()["days_on_trending"]
            assert online == PG.trend_days(df, KEY, "fetch_time").first()["days_on_trending"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_stream_and_restart(spark):
    empty = scratch_path(spark, "block-none")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert _rows(BL.merged(_drained(spark, empty), KEY)) == []
    files = _random_files(5, n_files=2, n_rows=50)
    path, table, checkpoint = _files(spark, files), scratch_path(spark, "block-table"), scratch_path(spark, "block-again")
    once = _rows(BL.merged(_drained(spark, path, table=table, checkpoint=checkpoint), KEY))
    again = _rows(BL.merged(_drained(spark, path, table=table, checkpoint=checkpoint), KEY))
    assert once == again == _plain(files)
