"""CSV files whose headers differ, in one table.

The first line of each file decides its columns. One scan finds the headers (each task passes on one line
a file), the files are grouped by header, each group is scanned with its own columns, and the groups are
united by name with the wanted types: an absent column is null, a value that does not convert is
null, a line that does not fit its file's header goes to the side table with its file and the reason. The
driver sees a header for each file, as it does the file names.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "value string, source_file string, reason string"
LINE = "_line_as_read"


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """header line -> files that begin with it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").withColumn("i", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "i").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(r["header"].lstrip("﻿"), []).append(r["file"])
    return out


def read_csv_by_header(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of ``schema``, lines that could not be read: value, source_file, reason)."""
    good, bad = [spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))], [spark.createDataFrame([], BAD)]
    for header, files in headers(spark, path).items():
        names = [n.strip() for n in next(csv.reader([header]), [])]
        if len({n.lower() for n in names}) < len(names) or not any(names):
            lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("source_file"))
            bad.append(lines.select("value", "source_file", F.lit("the header names a column twice or none").alias("reason")))
            continue
        columns = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(LINE, T.StringType())])
        rows = (spark.read.schema(columns).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
                .option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(files))
        by_name = {n.lower(): n for n in names}

        def typed(f: T.StructField):
            if f.name.lower() not in by_name:
                return F.lit(None).cast(f.dataType).alias(f.name)
            c = F.col(f"`{by_name[f.name.lower()]}`")
            if isinstance(f.dataType, T.TimestampType):
                return F.try_to_timestamp(c).alias(f.name)
            c = c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)
            return (F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name)

        good.append(rows.where(F.col(LINE).isNull()).select(*[typed(f) for f in schema.fields]))
        file = F.col("_metadata.file_path").alias("source_file")
        broken = rows.select(F.col(LINE).alias("value"), file, F.coalesce(F.col(f"`{names[0]}`"), F.lit("")).alias("first")).where("value is not null")
        bad.append(broken.select("value", "source_file", F.concat(F.lit("does not fit the header, beginning "), F.substring("first", 1, 40)).alias("reason")))
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)
