"""Joins (J1-J10).

Broadcast is used only for inputs whose size is bounded by construction
(the 32-row category dimension, a k-row top list, a one-row statistics
frame). Everything that grows with the data is left to the planner, where AQE
turns a join into a broadcast only after measuring the built side at run time,
and splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark import schema as S


def category_lookup(spark: SparkSession, df: DataFrame, key: str = "category_id",
                    out_col: str = "category_name") -> DataFrame:
    """Left join the fixed category dimension; miss or null id -> 'Unknown'."""
    dim = S.category_dimension(spark).withColumnRenamed("category_name", "_cat_name")
    j = df.join(F.broadcast(dim), df[key] == dim["category_id"], "left")
    j = j.drop(dim["category_id"])
    return j.withColumn(out_col, F.coalesce(F.col("_cat_name"), F.lit(S.UNKNOWN_CATEGORY))).drop("_cat_name")


def attach_group_stats(df: DataFrame, keys: list[str], aggs: dict) -> DataFrame:
    """Per-group aggregates mapped back to every row.

    Written as groupBy + join instead of a window over ``partitionBy(keys)``:
    the aggregate is partial before its shuffle, and the join back is a
    many-to-one equi-join whose skewed partitions AQE splits, whereas a
    window would have to put all rows of a hot key into one task.
    """
    stats = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(stats, keys, "left")


def with_scalar_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach every column of a one-row statistics frame as scalar subqueries
    (use when each column is referenced once; see ``with_stats_row`` otherwise)."""
    return df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def with_stats_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Put the columns of a one-row statistics frame (an ungrouped aggregate: exactly one
    row by construction) beside every row. The row is computed once and broadcast; a scalar
    subquery per reference would instead re-run the statistics plan for every reference."""
    return df.crossJoin(F.broadcast(stats))


def day_lookup(df: DataFrame, name_col: str, out_col: str = "weekday") -> DataFrame:
    """Day name -> number (0 = Monday) through an array position (no join)."""
    arr = F.array(*[F.lit(d) for d in S.DAY_NAMES])
    return df.withColumn(out_col, (F.array_position(arr, F.col(name_col)) - 1).cast("int"))


def importance_outer(long: DataFrame, models: list[str], top_n: int = 10) -> DataFrame:
    """(model, feature, importance) long rows -> feature x model table,
    missing = 0, mean across models, top n features by mean."""
    wide = long.groupBy("feature").pivot("model", models).agg(F.first("importance")).fillna(0.0)
    mean = sum((F.col(f"`{m}`") for m in models), F.lit(0.0)) / len(models)
    return wide.withColumn("mean_importance", mean).orderBy(F.desc("mean_importance"), "feature").limit(top_n)
