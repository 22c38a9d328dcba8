"""Online snapshot state that closes (T3, W6): one small row for each key and block of days.

A key's history is cut into blocks of ``BLOCK_DAYS`` calendar days. The state of a (key, block) is a
declarative aggregate - rows, first and last snapshot, and one long with a bit for each day on which the
key was seen - so Spark combines it before the shuffle, and a key with a third of all rows sends one row a
task. When the watermark passes the end of a block, its state leaves the store: the store holds the blocks
that the last ``late`` days touch, however long the stream runs and however many keys it has met.

In update mode each micro-batch gives the blocks that it changed; ``merged`` takes the fullest version of
each block (its row count only grows, so batches that are replayed or read in another order change
nothing) and joins the blocks of a key. In append mode each block comes once, when it is closed.

Results: days are those of the session's time zone. Rows without a time take no part; rows that come
after the watermark has passed the end of their block are left out, all others count, in whatever order
they come. Repeated rows count as rows but make no further day. Null keys are keys. Snapshots of one time
are ordered by the tie-break column. An empty stream gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.streaming.progression import DEFAULT_KEY, DEFAULT_VALUES

BLOCK_DAYS = 64  # one bit of a long for each day


def wall_clock(df: DataFrame, time: str) -> Column:
    """The local date and time of ``time`` as a timestamp counted from 1970 without zones, so that days and
    windows have the same borders in any time zone."""
    return F.from_utc_timestamp(F.col(time).cast("timestamp"), df.sparkSession.conf.get("spark.sql.session.timeZone"))


def block_state(df: DataFrame, key=DEFAULT_KEY, time: str = "fetch_time", tiebreak: str = "snapshot_id",
                values=DEFAULT_VALUES, late: str | None = "1 day") -> DataFrame:
    """(key, block_start, n, first, last, days) of a stream or a batch; ``late`` is the watermark's delay."""
    timed = df.withColumn("_wall", wall_clock(df, time))
    if late is not None:
        timed = timed.withWatermark("_wall", late)
    point = F.struct(F.col(time).alias("t"), F.col(tiebreak).alias("id"), *[F.col(v).alias(v) for v in values])
    day = F.floor(F.unix_micros("_wall") / F.lit(86_400_000_000))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(BLOCK_DAYS)).cast("int"))
    state = timed.groupBy(*key, F.window("_wall", f"{BLOCK_DAYS} days").alias("_block")).agg(
        F.count(F.lit(1)).alias("n"), F.min(point).alias("first"), F.max(point).alias("last"), F.bit_or(bit).alias("days"))
    return state.select(*key, F.col("_block.start").alias("block_start"), "n", "first", "last", "days")


def merged(blocks: DataFrame, key=DEFAULT_KEY) -> DataFrame:
    """(key, snapshot_count, first, last, days_on_trending) from any versions of the blocks of each key."""
    version = F.struct("n", "first", "last", "days")
    newest = blocks.groupBy(*key, "block_start").agg(F.max_by(version, "n").alias("b"))
    return newest.groupBy(*key).agg(
        F.sum("b.n").alias("snapshot_count"), F.min("b.first").alias("first"), F.max("b.last").alias("last"),
        F.sum(F.bit_count("b.days")).alias("days_on_trending"))
