"""A bootstrap band of a mean, as one aggregate.

Each row stands in each replicate a number of times drawn from a Poisson distribution of mean 1 (the limit
of drawing n of n rows with replacement), by a hash of its key and the replicate: the same band on any
partitioning, and in SQL. A replicate's mean is a sum of weighted values over a sum of weights, so
all replicates are one partial aggregate; the band is a percentile over the replicates' means.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS_A_HASH = 4  # of 8 hexadecimal digits each


def poisson_limits(draws: int = 12) -> list[int]:
    """For k = 0, 1, ... the first 32-bit number that draws more than k."""
    total, out = 0.0, []
    for k in range(draws):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * 2**32))
    return out


def _weight(digits: Column) -> Column:
    u = F.conv(digits, 16, 10).cast("bigint")
    return sum((F.when(u >= limit, 1).otherwise(0) for limit in poisson_limits()), F.lit(0))


def bootstrap_band(df: DataFrame, by: str, col: str, key: str, replicates: int = 100, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(by, n, mean, ci_lo, ci_hi) over the non-null values of ``col``; ``key`` tells the rows apart."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(by), F.col(col).cast("double").alias("_x"), F.col(key).cast("string").alias("_key"))
    plain = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    hashes = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS_A_HASH) - 1))))
    hashed = hashes.withColumn("_h", F.md5(F.concat_ws(":", "_key", F.lit(str(seed)), F.col("_part").cast("string"))))
    each = F.array(*[F.struct((F.col("_part") * DRAWS_A_HASH + i).alias("r"), F.substring("_h", 8 * i + 1, 8).alias("d")) for i in range(DRAWS_A_HASH)])
    drawn = hashed.select(by, "_x", F.explode(each).alias("e")).where(F.col("e.r") < replicates).select(by, "_x", F.col("e.r").alias("_r"), _weight(F.col("e.d")).alias("_w"))
    means = drawn.groupBy(by, "_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    band = means.groupBy(by).agg(F.percentile("_m", [tail, 1 - tail]).alias("_b"))  # a value a replicate
    return plain.join(band, by).select(by, "n", "mean", F.col("_b")[0].alias("ci_lo"), F.col("_b")[1].alias("ci_hi"))
