"""Window-shaped operators (W2, W7) that stay distributed.

``global_percent_rank`` is an exact ``percent_rank()`` over a whole column
without the single-partition global window Spark would plan for
``percent_rank().over(Window.orderBy(col))``:

1. distinct values with their counts (partial aggregation: a hot value is one row),
2. approximate cut points of those values (one bounded row) label ascending pieces,
3. running count inside each piece (window per piece),
4. per-piece totals (at most ``partitions`` rows) turned into offsets,
5. rank = offset + running count below; mapped back by an equi-join on the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.session import shared_dir


def value_ranks(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(value, rows_below, n) for every distinct non-null value of ``col``.

    Pieces are labelled from the data, not from partition ids: ``percentile_approx`` over the
    distinct values gives at most ``partitions`` - 1 cut points (one bounded row), and a
    value's piece is the number of cut points at or below it. Running counts are taken
    inside pieces; piece totals (at most ``partitions`` rows) become offsets.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    # the distinct values feed four branches (cut points, running counts, totals, n): write them
    # once to the shared folder so the upstream plan runs once (and the lineage is cut)
    shared_dir(spark)
    counts = counts.checkpoint(eager=True)
    fractions = [i / parts for i in range(1, parts)]
    cuts = counts.agg(F.percentile_approx(col, fractions, 10000).alias("_cuts")) if fractions else \
        counts.agg(F.array().alias("_cuts"))
    # cuts is one row (an ungrouped aggregate): broadcast beside the distinct values
    labelled = counts.crossJoin(F.broadcast(cuts)).withColumn(
        "_pid", F.size(F.filter(F.col("_cuts"), lambda b: b <= F.col(col)))).drop("_cuts")
    local = labelled.withColumn(
        "_below_local",
        F.sum("_c").over(Window.partitionBy("_pid").orderBy(col)
                         .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c"))
    totals = labelled.groupBy("_pid").agg(F.sum("_c").alias("_pc"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_pc").over(Window.orderBy("_pid")
                                             .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = totals.select(F.sum("_pc")).scalar()
    # offsets has at most `parts` rows: a proven bound, so it is broadcast
    ranks = local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    return ranks.select(col, (F.col("_off") + F.col("_below_local")).alias("rows_below"), n.alias("n"))


def global_percent_rank(df: DataFrame, col: str, out: str = "pct_rank", partitions: int | None = None) -> DataFrame:
    """Exact percent_rank of ``col`` over the whole frame: (rank-1)/(n-1), 0 when n = 1."""
    r = value_ranks(df, col, partitions)
    r = r.select(col, F.when(F.col("n") > 1, F.col("rows_below") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias(out))
    return df.join(r, col, "left")


def argmax_per_group(df: DataFrame, group, metric: str, tiebreak: str) -> DataFrame:
    """The row with the highest (numeric) metric per group, ties -> smallest tie-break.

    A ``min_by`` over (-metric, tiebreak): partial per task, no per-group sort of raw rows,
    so a group holding a third of all rows costs one partial row per task."""
    keys = [group] if isinstance(group, str) else list(group)
    others = [c for c in df.columns if c not in keys]
    best = (df.where(F.col(metric).isNotNull()).groupBy(*keys)
            .agg(F.min_by(F.struct(*[F.col(c) for c in others]),
                          F.struct(-F.col(metric), F.col(tiebreak))).alias("_r")))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
