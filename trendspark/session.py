"""Session helpers: a tuned local session for tests/bench and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROWS_A_TASK = 5000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "trendspark") -> SparkSession:
    """Session used by tests and bench; a cluster job gets its session from spark-submit."""
    master = master or os.environ.get("TRENDSPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRENDSPARK_DRIVER_MEM", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured for the session. Only where
    nothing is configured (tests, local runs on one machine) a scratch folder is made and set
    as the context's checkpoint folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="trendspark-ckpt-")
    sc.setCheckpointDir(local)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back: iterative jobs (model fits, CV
    folds, search draws) then scan a small columnar table instead of recomputing the
    lineage, and a lost executor costs a re-read, not a recomputation from raw text."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    # few enough partitions that iterative fits do not pay task overhead for next to nothing, and enough that
    # all cores work on a table that is small in bytes and costly in rows: one for maxPartitionBytes or for
    # ROWS_A_TASK rows (these up to the cores)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    split = int(str(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")).rstrip("b"))
    by_rows = min(spark.sparkContext.defaultParallelism, -(-back.count() // ROWS_A_TASK))
    want = max(1, -(-size // split), by_rows)
    return back.coalesce(want) if want < back.rdd.getNumPartitions() else back
