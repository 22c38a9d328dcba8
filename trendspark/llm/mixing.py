"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that gives it its target share of
as many documents as there are: rate = weight x rows / rows of the source. Each document draws
its number of copies by inverting the Poisson distribution with that mean at a uniform number
hashed from seed and id; it is exploded by the count, and all copies are put in a global order
by another hash. That hash is uniform on [0, 1), so partition i of n takes its values from i / n
to (i + 1) / n and sorts them: the borders are known and no pass samples the texts for them. No rate is cut: a source of few documents gets its
share by as many copies of each as that takes. So the draw of a document depends on its id, its
source's rate and the seed alone: repeats and lost executors give the same mix.

Scale: one aggregate by source (pre-aggregated in the scan), then one shuffle of what is kept, by
a hash, so a source with a third of all rows is spread evenly, into spark.sql.shuffle.partitions
partitions. The table of sources is broadcast
only if it has at most ``BROADCAST_SOURCES`` rows, which is counted first; beyond that it is
joined by a shuffle.

Results: weights are relative; a source without a weight (when weights are given) is left out, as
is one with weight 0; without weights all sources weigh the same. A null source is a source of
its own (key None). Rows with one id draw alike, rows without an id by their text. Null and empty
texts are mixed like others. Ties in the order go by id and copy. An empty table gives an empty table; all columns
of the input are kept, and the new ones get free names if theirs are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import fresh

SEED = 17
BROADCAST_SOURCES = 10_000
HASH_DIGITS = 13  # hexadecimal digits of a hash that make a uniform number: 52 bits
FROM_ZERO_RATE = 200.0  # up to here terms are added up from P(X = 0); exp(-rate) would underflow beyond about 700
COPIES_A_BLOCK = 10_000  # copies are listed in blocks, so no array grows with a document's number of copies


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def _log_term(rate: Column, k: Column) -> Column:
    """ln P(X = k) for X Poisson with mean ``rate`` and k > 0, by Stirling's series, without the difference of large numbers."""
    apart = (rate - k) / k
    series = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    return k * (F.log1p(apart) - apart) - 0.5 * F.log(2 * math.pi * k) - series


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k) for X Poisson with mean ``rate``, by adding up terms.

    For large rates the terms begin 12 standard deviations below the mean: what lies before them
    (less than 1e-30) is below the resolution of u, and the number of terms grows with the root of
    the rate only."""
    first = F.when(rate <= FROM_ZERO_RATE, F.lit(0.0)).otherwise(F.floor(rate - 12 * F.sqrt(rate)).cast("double"))
    begin = F.when(rate <= FROM_ZERO_RATE, F.exp(-rate)).otherwise(F.exp(_log_term(rate, first)))
    state = F.struct(begin.alias("term"), begin.alias("sum"), first.cast("int").alias("k"))

    def step(s, i):
        term = s["term"] * rate / i
        return F.when(u < s["sum"], s).otherwise(F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), i.cast("int").alias("k")))

    terms = F.sequence(first.cast("int") + 1, F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    return F.aggregate(terms, state, step)["k"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, n_rows, rate): one row for each source that takes part."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = n.withColumn("weight", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        named = table.withColumnRenamed("source", "named")
        weighed = n.join(F.broadcast(named) if len(weights) <= BROADCAST_SOURCES else named, F.col("source").eqNullSafe(F.col("named"))).drop("named").where("weight > 0")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n")).first()
    share = F.col("weight") / F.lit(sums["w"] or 1.0)
    return weighed.select("source", "n_rows", (share * F.lit(float(sums["n"] or 0)) / F.col("n_rows")).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its draw, in a global random order, and the columns
    n_copies, copy (from 0) and place (the hash that it is ordered by)."""
    source, rate, u, n_copies, copy, place = fresh(docs, "mix_source", "mix_rate", "mix_u", "n_copies", "copy", "place")
    table = rates(docs, weights).select(F.col("source").alias(source), F.col("rate").alias(rate))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col(source))).withColumn(u, uniform(F.lit(str(seed)), key))
    counted = drawn.withColumn(n_copies, poisson_count(F.col(u), F.col(rate))).drop(source, rate, u).where(F.col(n_copies) > 0)
    blocks = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1, F.lit(COPIES_A_BLOCK))))
    copies = blocks.withColumn(copy, F.explode(F.sequence(F.col(copy), F.least(F.col(copy) + (COPIES_A_BLOCK - 1), F.col(n_copies) - 1))))
    placed = copies.withColumn(place, uniform(F.lit(f"{seed} place"), key, F.col(copy).cast("string")))
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.least(F.floor(F.col(place) * slices), F.lit(slices - 1)).cast("int")
    return placed.repartitionById(slices, own).sortWithinPartitions(place, "doc_id", copy)
