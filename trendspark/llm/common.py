"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage is cut there, so a lost
    executor costs a read and not the work before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids, the first by a hash of the id.

    An id with no label or with two different labels takes no part; repeated rows count once.
    The result is at most ``rows`` rows of 16 bytes, so it may be broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if keep is not None:
        known = known.where(keep)
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    return one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def chunks(texts: list[str], most_chars: int):
    """Index ranges [a, b) of consecutive texts with about ``most_chars`` characters each."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and the given columns, each computed once a row: as a generator of one row. Spark merges
    neither a later projection nor a later filter into it, which would copy the expression to each
    place that refers to it, also into the bodies of lambdas."""
    (name,) = fresh(df, "bound")
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(name)
    return df.select("*", made).select(*(F.col(c) for c in df.columns), f"{name}.*")


def release() -> None:
    """Give back to the system what this process no longer uses: Python workers live on between tasks,
    and what one keeps counts against its executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


_held: list = [None, None]


def held(name: str, make=lambda: None):
    """What ``make`` gave for ``name`` in this worker process; that of another operator is dropped first,
    so a worker that serves several operators one after the other holds the tables of one."""
    if _held[0] != name:
        _held[:] = None, None
        release()
        _held[:] = name, make()
    return _held[1]


def byte_texts(column, most_bytes: int):
    """(index of the first, UTF-8 bytes of each) of consecutive texts of an Arrow string column, with
    about ``most_bytes`` in each piece, so that never all texts of a batch are Python objects at once.
    Null texts are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, "right")))
        piece = column.slice(a, b - a)
        yield a, pc.fill_null(piece, "").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        a = b
