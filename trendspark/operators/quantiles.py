"""Exact quantiles of any number of groups, without a value map or a list of groups on the driver.

Groups of up to SMALL values are sorted whole, each in one bounded array. For larger ones the open value
intervals of the wanted ranks live in a table: each pass joins the values with the intervals of their group
(salted, so that one group is many tasks), counts them in equal-width buckets and keeps for each rank the
bucket that holds it, until it holds one distinct value. Null, NaN and infinite values take no part.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.session import materialize

SMALL, BUCKETS, SALTS = 10_000, 256, 16


def _interpolated(at, n, probs: list[float]):
    """The array of quantiles; ``at(k)`` is the value of rank k (from 0), ``n`` the number of values."""
    out = []
    for p in probs:
        h = (n - 1) * F.lit(float(p))
        k = F.floor(h)
        low, high = at(k), at(F.least(k + 1, n - 1))
        out.append(low + (high - low) * (h - k))
    return F.array(*out)


def quantiles_of_groups(df: DataFrame, group: str, col: str, probs: list[float], small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """(group, q): linear-interpolated quantiles of ``col`` for each value of ``group``."""
    spark = df.sparkSession
    v = df.select(F.col(group).alias("c"), F.col(col).cast("double").alias("v")).where("c is not null and v is not null and not isnan(v) and abs(v) < double('infinity')")
    sizes = materialize(spark, v.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "group-sizes")
    few = v.join(sizes.where(F.col("n") <= small).select("c"), "c", "left_semi").groupBy("c").agg(F.sort_array(F.collect_list("v")).alias("s"))
    out = few.select(F.col("c").alias(group), _interpolated(lambda k: F.get("s", k.cast("int")), F.size("s"), probs).alias("q"))
    large = sizes.where(F.col("n") > small)
    if large.isEmpty():
        return out
    salted = v.join(large.select("c"), "c", "left_semi").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = _ranked(salted, large, probs, buckets)
    finally:
        salted.unpersist()
    values = found.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("k", "a"))).alias("m")).join(large.select("c", "n"), "c")
    of_large = values.select(F.col("c").alias(group), _interpolated(lambda k: F.element_at("m", k.cast("long")), F.col("n"), probs).alias("q"))
    return out.unionByName(of_large)


def _ranked(salted: DataFrame, large: DataFrame, probs: list[float], buckets: int) -> DataFrame:
    """(c, k, a): the value a of each wanted rank k of each group."""
    spark = salted.sparkSession
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * F.lit(float(p))), F.least(F.floor((F.col("n") - 1) * F.lit(float(p))) + 1, F.col("n") - 1)) for p in probs])))
    state = large.select("c", F.explode(ranks).alias("k"), F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(0).cast("long").alias("below"))
    while True:
        state = materialize(spark, state, "open-ranks")
        open_ = state.where("a < b")
        if open_.isEmpty():
            return state.select("c", "k", "a")
        intervals = open_.select("c", "a", "b").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        inside = salted.join(intervals, ["c", "salt"]).where("v >= a and v <= b")
        width = (F.col("b") - F.col("a")) / buckets
        place = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), width)), F.lit(buckets - 1))).otherwise(F.when(F.col("v") == F.col("a"), 0).otherwise(buckets - 1))
        counts = inside.groupBy("c", "a", "b", place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        upto = F.sum("cnt").over(Window.partitionBy("c", "a", "b").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most ``buckets`` rows
        placed = counts.withColumn("upto", upto)
        held = open_.join(placed, ["c", "a", "b"]).where((F.col("k") < F.col("below") + F.col("upto")) & (F.col("k") >= F.col("below") + F.col("upto") - F.col("cnt")))
        state = state.where("a = b").unionByName(held.select("c", "k", F.col("mn").alias("a"), F.col("mx").alias("b"), (F.col("below") + F.col("upto") - F.col("cnt")).alias("below")))
