"""Statistics operators.

Whole-table statistics are one-row aggregates; they are attached to rows as
scalar subqueries (J10), never through a join that fans out.

Exact quantiles: Spark's ``percentile`` keeps one value->count map per group,
which is exact but grows with the number of distinct values. ``approx=True``
switches to ``percentile_approx`` (bounded memory, rank error 1/accuracy).
``exact_quantile`` is the scalable exact path for one global quantile: it
narrows the target rank with a few bucketed counting passes (each pass is a
distributed partial aggregate that returns at most ``buckets`` rows) and only
materialises the final, small candidate set.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantile_expr(col: str, p, approx: bool = False, accuracy: int = 100000) -> Column:
    """Linear-interpolated quantile (pandas default) or its approximation."""
    if approx:
        return F.percentile_approx(col, p, accuracy)
    return F.percentile(col, p)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], buckets: int = 1024,
                    final_rows: int = 50000) -> list[float | None]:
    """Exact linear-interpolated quantiles of one whole column (see ``exact_quantiles_multi``)."""
    return exact_quantiles_multi(df, {col: probs}, buckets, final_rows)[col]


def exact_quantile(df: DataFrame, col: str, p: float, buckets: int = 1024,
                   final_rows: int = 50000) -> float | None:
    """One exact quantile (see ``exact_quantiles_multi``)."""
    return exact_quantiles(df, col, [p], buckets, final_rows)[0]


def exact_quantiles_multi(df: DataFrame, wanted: dict[str, list[float]], buckets: int = 1024,
                          final_rows: int = 50000) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of whole columns without a global value map.

    For each p the rank h = (n-1)p needs the values at ranks floor(h) and floor(h)+1
    (0-based). The columns are stacked into one persisted (column, value) table and all
    wanted ranks of all columns are searched together: every pass is ONE distributed
    aggregate that splits each open value interval into ``buckets`` equal-width buckets
    (partial aggregation; at most buckets x intervals rows reach the driver), keeps the
    buckets holding wanted ranks, and stops for a rank when its bucket holds one distinct
    value (a hot value ends the search at once) or at most ``final_rows`` rows, which are
    then read in order. A few passes replace the one-task merge of Spark's ``percentile``.
    """
    cols = list(wanted)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(cols)])
    long = df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
    long = long.persist(StorageLevel.MEMORY_AND_DISK)  # reused by every pass; rebuilt from lineage if lost
    try:
        return _exact_quantiles(long, list(range(len(cols))), cols, wanted, buckets, final_rows)
    finally:
        long.unpersist()


def exact_quantiles_by_group(df: DataFrame, group: str, col: str, probs: list[float], buckets: int = 1024,
                             final_rows: int = 50000) -> dict:
    """Exact quantiles of ``col`` per value of ``group`` by the same bucketed selection (a
    group holding a third of all rows is split into buckets like any other). Meant for
    bounded group sets (dimensions): the driver keeps one open interval per group and rank."""
    long = (df.select(F.col(group).alias("c"), F.col(col).cast("double").alias("v"))
            .where(F.col("v").isNotNull() & F.col("c").isNotNull()))
    long = long.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        keys = [r["c"] for r in long.select("c").distinct().collect()]
        names = [str(k) for k in keys]
        res = _exact_quantiles(long, keys, names, {n: probs for n in names}, buckets, final_rows)
        return {k: res[n] for k, n in zip(keys, names)}
    finally:
        long.unpersist()


def _exact_quantiles(v: DataFrame, keys: list, cols: list[str], wanted: dict[str, list[float]], buckets: int,
                     final_rows: int) -> dict[str, list[float | None]]:
    stats = {r["c"]: r for r in v.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                                     F.max("v").alias("hi")).collect()}
    plans: dict = {}
    open_ = []  # (key, lo, hi, rows below lo, ranks inside)
    for ci, c in zip(keys, cols):
        st = stats.get(ci)
        if st is None:
            continue
        n = st["n"]
        plans[ci] = []
        for p in wanted[c]:
            h = (n - 1) * p
            k0 = int(math.floor(h))
            plans[ci].append((k0, h - k0))
        ranks = sorted({k for k0, frac in plans[ci] for k in ([k0] if frac == 0 or k0 + 1 >= n else [k0, k0 + 1])})
        open_.append((ci, st["lo"], st["hi"], 0, ranks))
    found: dict[tuple[int, int], float] = {}
    while open_:
        for ci, a, b, _, ranks in open_:
            if a == b:
                for k in ranks:
                    found[(ci, k)] = a
        open_ = [iv for iv in open_ if iv[1] != iv[2]]
        if not open_:
            break
        iid, bucket = None, None
        for i, (ci, a, b, _, _) in enumerate(open_):
            inside = (F.col("c") == ci) & (F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b))
            bk = F.least(F.floor((F.col("v") - F.lit(a)) / F.lit((b - a) / buckets)), F.lit(buckets - 1))
            iid = F.when(inside, F.lit(i)) if iid is None else iid.when(inside, F.lit(i))
            bucket = F.when(inside, bk) if bucket is None else bucket.when(inside, bk)
        counts = (v.select(iid.alias("i"), bucket.cast("int").alias("b"), "v").where(F.col("i").isNotNull())
                  .groupBy("i", "b").agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("mn"),
                                         F.max("v").alias("mx"))
                  .orderBy("i", "b").collect())
        by_interval: dict[int, list] = {}
        for r in counts:
            by_interval.setdefault(r["i"], []).append(r)
        nxt = []
        for i, (ci, _, _, offset, ranks) in enumerate(open_):
            acc = offset
            pending = list(ranks)
            for r in by_interval.get(i, []):
                here = [k for k in pending if acc <= k < acc + r["cnt"]]
                if here:
                    if r["mn"] == r["mx"]:
                        for k in here:
                            found[(ci, k)] = r["mn"]
                    elif r["cnt"] <= final_rows:
                        vals = (v.where((F.col("c") == ci) & (F.col("v") >= r["mn"]) & (F.col("v") <= r["mx"]))
                                .select("v").orderBy("v").limit(max(here) - acc + 1).collect())
                        for k in here:
                            found[(ci, k)] = vals[k - acc]["v"]
                    else:
                        nxt.append((ci, r["mn"], r["mx"], acc, here))
                    pending = [k for k in pending if k not in here]
                acc += r["cnt"]
        open_ = nxt
    out: dict[str, list[float | None]] = {}
    for ci, c in zip(keys, cols):
        if ci not in plans:
            out[c] = [None for _ in wanted[c]]
            continue
        n = stats[ci]["n"]
        res = []
        for k0, frac in plans[ci]:
            a = found[(ci, k0)]
            if frac == 0 or k0 + 1 >= n:
                res.append(a)
            else:
                b = found[(ci, k0 + 1)]
                res.append(a + (b - a) * frac)
        out[c] = res
    return out


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation that is null (not an ANSI divide-by-zero error) for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of mean and sample sd per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__sd")]
    return df.agg(*aggs)


def with_zscores(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """F9 + A18 + J10: z-score per column from whole-table mean/sd (0 when sd is 0 or null).
    The one-row moments frame is computed once and broadcast beside every row."""
    from trendspark.operators.lookups import with_stats_row
    m = moments(df, cols)
    j = with_stats_row(df, m)
    out = {}
    for c in cols:
        mean, sd = F.col(f"{c}__mean"), F.col(f"{c}__sd")
        out[f"{c}{suffix}"] = F.when(F.coalesce(sd, F.lit(0.0)) > 0, (F.col(c) - mean) / sd).otherwise(F.lit(0.0))
    return j.withColumns(out).drop(*m.columns)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, in one aggregate, as long rows.

    A constant column gives null (not an error): the pair is guarded by sd > 0.
    """
    aggs = []
    for c in cols:
        aggs.append(F.stddev_pop(c).alias(f"sd__{c}"))
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(safe_corr(a, b).alias(f"r__{a}__{b}"))
    wide = df.agg(*aggs)
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                val = F.when(F.col(f"sd__{a}") > 0, F.lit(1.0))
            else:
                x, y = (a, b) if cols.index(a) < cols.index(b) else (b, a)
                val = F.when((F.col(f"sd__{a}") > 0) & (F.col(f"sd__{b}") > 0), F.col(f"r__{x}__{y}"))
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), val.alias("corr")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe_numeric(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """A12 (numeric part): count, mean, std, min, 25%, 50%, 75%, max as long rows.

    Quartiles come from the distributed exact selection (``exact_quantiles``), or from
    ``percentile_approx`` with ``exact=False``."""
    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    aggs = []
    quart = exact_quantiles_multi(df, {c: [0.25, 0.5, 0.75] for c in cols}) if exact else {}
    for c in cols:
        if exact:
            qs = [F.lit(x).cast("double") for x in quart[c]]
        else:
            qs = [F.percentile_approx(c, p, 100000).cast("double") for p in (0.25, 0.5, 0.75)]
        aggs += [F.count(c).cast("double").alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 qs[0].alias(f"{c}__25%"), qs[1].alias(f"{c}__50%"),
                 qs[2].alias(f"{c}__75%"), F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"`{c}__{s}`").alias("value"))
            for c in cols for s in stats]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe_categorical(df: DataFrame, col: str) -> DataFrame:
    """A12 (object part): count, unique, top (most frequent; ties -> smallest), freq. One row."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("freq"))
    return counts.agg(
        F.sum("freq").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col(col), F.struct(-F.col("freq"), F.col(col))).alias("top"),
        F.max("freq").alias("freq"),
    )


def histogram(df: DataFrame, col: str, bins: int, lo=None, hi=None) -> DataFrame:
    """Equal-width bins over [min, max] (or given bounds); last bin closed.

    The bounds are one row (computed once, broadcast beside the rows). Rows outside the
    range get a null bin inside the grouping key instead of being filtered out."""
    from trendspark.operators.lookups import with_stats_row
    v = df.select(F.col(col).alias("_x"))
    if lo is None or hi is None:
        bounds = v.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        if lo is not None:
            bounds = bounds.withColumn("_lo", F.lit(lo))
        if hi is not None:
            bounds = bounds.withColumn("_hi", F.lit(hi))
        j = with_stats_row(v, bounds)
    else:
        j = v.withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})
    x, lo_c, hi_c = F.col("_x"), F.col("_lo"), F.col("_hi")
    width = hi_c - lo_c
    idx = F.when(x.isNotNull() & (x >= lo_c) & (x <= hi_c),
                 F.when(width == 0, F.lit(0)).otherwise(
                     F.least(F.floor((x - lo_c) / width * bins), F.lit(bins - 1))).cast("int"))
    out = (j.groupBy(idx.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
           .where(F.col("bin").isNotNull()))
    w = F.col("_hi") - F.col("_lo")
    return out.select("bin", "count", (F.col("_lo") + w * F.col("bin") / bins).alias("bin_lo"),
                      (F.col("_lo") + w * (F.col("bin") + 1) / bins).alias("bin_hi"))


def histogram_by_group(df: DataFrame, group: str, col: str, bins: int) -> DataFrame:
    """A19 per group: equal-width bins over each group's own [min, max] (last bin closed).
    The per-group bounds are a small aggregate joined back on the group key."""
    bounds = df.groupBy(group).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x, lo, hi = F.col(col), F.col("_lo"), F.col("_hi")
    width = hi - lo
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width * bins), F.lit(bins - 1))).cast("int")
    j = df.select(group, col).join(bounds, group)
    out = (j.groupBy(group, F.when(x.isNotNull(), idx).alias("bin"), "_lo", "_hi")
           .agg(F.count(F.lit(1)).alias("count")).where(F.col("bin").isNotNull()))
    return out.select(group, "bin", "count", (lo + width * F.col("bin") / bins).alias("bin_lo"),
                      (lo + width * (F.col("bin") + 1) / bins).alias("bin_hi"))


def box_numbers(df: DataFrame, group: str, col: str, approx: bool = False) -> DataFrame:
    """Quartiles, IQR, whiskers (furthest points within 1.5 IQR) and outlier count per group.

    Two aggregates: quartiles per group, then one pass over rows joined to their
    group's quartiles (many-to-one; the per-group side is small).
    """
    if approx:
        qs = F.percentile_approx(col, [0.25, 0.5, 0.75], 100000)
        qt = df.groupBy(group).agg(qs.alias("q"), F.count(col).alias("n"))
    else:
        from trendspark.operators.quantiles import quantiles_of_groups
        qt = df.groupBy(group).agg(F.count(col).alias("n")).join(quantiles_of_groups(df, group, col, [0.25, 0.5, 0.75]), group)
    qt = qt.select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    qt = qt.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(group, col).join(qt, group)
    lo_fence = F.col("q1") - 1.5 * F.col("iqr")
    hi_fence = F.col("q3") + 1.5 * F.col("iqr")
    x = F.col(col)
    agg = j.groupBy(group).agg(
        F.min(F.when(x >= lo_fence, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_fence, x)).alias("whisker_hi"),
        F.sum(F.when((x < lo_fence) | (x > hi_fence), 1).otherwise(0)).cast("bigint").alias("outliers"))
    return qt.join(agg, group)


def mean_ci(df: DataFrame, by: str, col: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal 95% band (mean +- z*sd/sqrt(n)) per key."""
    g = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    return g.withColumns({"ci_lo": F.col("mean") - half, "ci_hi": F.col("mean") + half})
