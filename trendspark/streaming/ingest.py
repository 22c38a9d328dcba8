"""T1/T2 + S12: snapshot files as a stream, and a runner that drains it into a table.

``run_to_table`` drives a streaming query with ``trigger(availableNow=True)``:
it processes everything present (in bounded micro-batches), checkpoints its
offsets and state under the shared folder, writes each micro-batch's result
with ``foreachBatch`` (idempotent overwrite of the complete result, or append),
and stops. Re-running with the same checkpoint resumes where it left off, so an
executor or driver loss costs one micro-batch, not the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import scratch_path
from trendspark.sources.tables import read_table, table_path


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of the events table (same schema as the batch table)."""
    schema = read_table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    path = table_path(sf_dir, "events")
    if _is_dir(spark, path):
        return reader.parquet(path)
    # a single-file table: watch its folder, admit only that file name
    parent, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(parent)


def _is_dir(spark: SparkSession, path: str) -> bool:
    """Directory test through the Hadoop file system of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``snapshots`` adapter on a stream (stateless tagging + static region join)."""
    e = event_stream(spark, sf_dir)
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    s = e.join(F.broadcast(r), F.pmod(F.col("user_id"), F.lit(5)) == r.r_regionkey)
    return s.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("video_id"),
        F.col("event_type").alias("category_id"),
        F.col("r_name").alias("region"),
        F.col("ts").alias("fetch_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("views"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("likes"),
        F.floor(F.col("value") / 10).cast("bigint").alias("comments"),
    )


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "complete",
                 path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain ``stream`` (availableNow) into Parquet at ``path`` and return the batch view of it.

    Each micro-batch overwrites a folder of its own (``batch_id=N``), so a batch that is replayed
    after a lost commit replaces itself. In append mode the table is all batches, in update mode too (the
    reader takes the newest version of a key), in complete mode the last one; an earlier result stays
    readable until the next one is complete. A stream without any file gives an empty table.
    """
    path = path or scratch_path(spark, f"{name}-table")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(output_mode)
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise RuntimeError(str(q.exception()))
    if not _is_dir(spark, path):
        return spark.createDataFrame([], stream.schema)
    table = spark.read.parquet(path)
    if output_mode == "complete":
        last = table.agg(F.max("batch_id")).first()[0]
        table = spark.read.parquet(f"{path}/batch_id={last}") if last is not None else table
    return table.drop("batch_id")
