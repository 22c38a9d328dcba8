"""An upsert that rewrites only the buckets it touches.

The table is partitioned by a hash of its key. A batch of updates is merged with the buckets that hold its
keys, staged, and put in place of these buckets alone; the files of all other buckets stay as they
are. A batch id that has been applied is not applied again. Staging cuts the read from the overwrite, so a
lost executor or a repeated run finds the old buckets or the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import scratch_path
from trendspark.sources.files import upsert_latest

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_into(updates: DataFrame, path: str, key: list[str], order: str, batch: str, buckets: int = BUCKETS) -> bool:
    """Merge ``updates`` into the table at ``path``, the newest row by ``order`` of each key; False if ``batch`` was
    applied before. The number of buckets is fixed when the table is made."""
    spark = updates.sparkSession
    if _exists(spark, f"{path}/applied/{batch}"):
        return False
    own = updates.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    if touched:
        rows = f"{path}/rows"
        held = spark.read.parquet(rows).where(F.col("bucket").isin(touched)) if _exists(spark, rows) else own.limit(0)
        staged = scratch_path(spark, "upsert-staged")
        upsert_latest(held, own, [*key, "bucket"], order).write.parquet(staged)
        merged = spark.read.parquet(staged)
        merged.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(rows)
    spark.createDataFrame([(batch, len(touched))], "batch string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/applied/{batch}")
    return True


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("bucket")
