"""T5: a stream that keeps going when records or whole regions fail, and loses neither.

Each micro-batch of raw text lines is parsed; what is no JSON, lacks a required field or names an unknown
region goes to a side table with its file, the reason and the batch. The others are handled region by
region; a region whose handling raises goes to the side table as a whole, and the other regions go on.
Every row is in exactly one of the two tables. Batches write folders of their own, so a batch that is
replayed after a lost commit replaces itself. ``replay`` sends the side table's rows through the same
steps again (after a repair of their text, if one is given) and then marks the batches it has read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_REGIONS = 1000
SIDE = "value string, source_file string, reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class DeadLetters:
    """Where the tables are and what a good record is."""

    path: str
    schema: T.StructType
    required: tuple[str, ...]
    regions: tuple[str, ...]
    region: str = "region"
    handle: Callable[[DataFrame], DataFrame] = staticmethod(lambda df: df)

    def checked(self, raw: DataFrame) -> DataFrame:
        """(value, source_file, the record's fields, reason: null if it is good)."""
        kind = T.StructType([*self.schema.fields, T.StructField("_corrupt", T.StringType())])
        parsed = raw.withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        reason: Column = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), F.lit("not JSON"))
        for name in self.required:
            reason = reason.when(F.col(f"r.{name}").isNull(), F.lit(f"missing {name}"))
        reason = reason.when(~F.coalesce(F.col(f"r.{self.region}").isin(*self.regions), F.lit(False)), F.lit("unknown region"))
        return parsed.select("value", "source_file", *[F.col(f"r.{f.name}").alias(f.name) for f in self.schema.fields], reason.alias("reason"))

    def process(self, raw: DataFrame, batch: str) -> None:
        """Write one batch of (value, source_file) to the two tables."""
        spark = raw.sparkSession
        rows = self.checked(raw).persist()
        try:
            names = [f.name for f in self.schema.fields]
            good = rows.where("reason is null")
            found = [r[0] for r in good.select(self.region).distinct().orderBy(self.region).limit(MOST_REGIONS).collect()]  # of a fixed list
            failed: dict[str, str] = {}
            empty = spark.createDataFrame([], self.schema)
            self.handle(empty).write.mode("overwrite").parquet(f"{self.path}/good/batch={batch}/region_no=-1")
            for i, name in enumerate(found):
                try:
                    self.handle(good.where(F.col(self.region) == name).select(*names)).write.mode("overwrite").parquet(f"{self.path}/good/batch={batch}/region_no={i}")
                except Exception as e:  # this region waits in the side table, the others go on
                    failed[name] = f"region failed: {type(e).__name__}: {e}".split("\n")[0][:200]
                    empty_now = self.handle(empty)
                    empty_now.write.mode("overwrite").parquet(f"{self.path}/good/batch={batch}/region_no={i}")
            why = F.col("reason")
            for name, reason in failed.items():
                why = F.coalesce(why, F.when(F.col(self.region) == name, F.lit(reason)))
            bad = rows.withColumn("reason", why).where("reason is not null").select("value", "source_file", "reason")
            bad.write.mode("overwrite").parquet(f"{self.path}/bad/batch={batch}")
        finally:
            rows.unpersist()

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """Run a stream of (value, source_file) until its present input is used up."""
        query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                 .foreachBatch(lambda batch, number: self.process(batch, str(number))).start())
        query.awaitTermination()

    def good(self, spark: SparkSession) -> DataFrame:
        kept = self.handle(spark.createDataFrame([], self.schema)).schema
        return spark.read.schema(T.StructType([*kept.fields, T.StructField("batch", T.StringType())])).parquet(f"{self.path}/good")

    def bad(self, spark: SparkSession) -> DataFrame:
        """The side table's rows that no replay has read yet, with their batch."""
        every = spark.read.schema(SIDE + ", batch string").parquet(f"{self.path}/bad")
        return every.join(F.broadcast(self._replayed(spark)), "batch", "left_anti")

    def _replayed(self, spark: SparkSession) -> DataFrame:
        if not _exists(spark, f"{self.path}/replayed"):
            return spark.createDataFrame([], "batch string")
        return spark.read.schema("batch string").parquet(f"{self.path}/replayed").select("batch").distinct()  # a row a batch

    def replay(self, spark: SparkSession, name: str, repair: Callable[[Column, Column], Column] | None = None) -> None:
        """Send the waiting rows through again as batch ``replay-name``; ``repair`` gets (value, reason). A replay
        that is lost is run again under its name; one that is complete is not run again."""
        if _exists(spark, f"{self.path}/replayed/replay={name}/_SUCCESS"):
            return
        waiting = self.bad(spark).where(F.col("batch") != f"replay-{name}")
        batches = waiting.select("batch").distinct()
        text = F.col("value") if repair is None else repair(F.col("value"), F.col("reason"))
        self.process(waiting.select(text.alias("value"), "source_file"), f"replay-{name}")
        batches.write.mode("overwrite").parquet(f"{self.path}/replayed/replay={name}")


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file) of the text files below ``path``, as a stream."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", True).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"))
