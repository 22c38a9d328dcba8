"""M9 for logistic regression: all draws and folds of a search fitted in shared passes over the rows.

A model (a draw's C and mix of penalties, without one fold) is the minimum of Spark's objective: mean log
loss plus regParam * (elasticNetParam * |w| + (1 - elasticNetParam) / 2 * w^2), regParam = 1 / (C n), n being
all training rows, weights on the features as they are, the intercept free. Each pass adds up, for every
model that is still moving, its loss, gradient and curvature (d + 1 squared numbers); the driver then takes
a proximal Newton step for each (coordinate descent on those few numbers, halved if the objective rose).
A search so costs some tens of passes and not draws x folds fits of up to 2,000 iterations each. Draws that
differ only in ``maxIter``, which limits the steps, share a model that ended before. Columns are shifted and
scaled for the steps only. A last pass scores every row's held-out models for the exact area under the curve.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.ml.prefix import auc_by_group
from trendspark.ml.split import fold_column
from trendspark.session import materialize

TOLERANCE, ROUNDS, ROWS = 1e-9, 40, 4000


def _design(batch, d: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The rows of a batch as [1, scaled features]."""
    z = np.ones((len(batch), d + 1))
    for i in range(d):
        z[:, i + 1] = (batch.column(f"c{i}").to_numpy() - mean[i]) / scale[i]
    return z


def _sums(rows: DataFrame, d: int, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, without: np.ndarray) -> dict[int, np.ndarray]:
    """For each model (``weights`` rows, ``without`` its fold): [n, loss, gradient, curvature] over its training rows."""
    schema = "model int, total array<double>"

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(weights), 2 + (d + 1) + (d + 1) ** 2))
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                z, y, fold = _design(batch, d, mean, scale), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                margin = z @ weights.T
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                loss = np.logaddexp(0, margin) - y[:, None] * margin
                for m in range(len(weights)):
                    own = (fold != without[m]).astype(float)
                    total[m, 0] += own.sum()
                    total[m, 1] += own @ loss[:, m]
                    total[m, 2 : d + 3] += z.T @ (own * (p[:, m] - y))
                    total[m, d + 3 :] += ((z * (own * p[:, m] * (1 - p[:, m]))[:, None]).T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(weights)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "total"])

    def added(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for m, line in zip(batch.column("model").to_pylist(), batch.column("total"), strict=True):
                total[m] = total.get(m, 0.0) + line.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["model", "total"])

    return {r["model"]: np.array(r["total"]) for r in rows.mapInArrow(run, schema).repartition("model").mapInArrow(added, schema).collect()}


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The minimum of g.(v - w) + (v - w).h.(v - w) / 2 + penalties of v: a few rounds of coordinate descent find the
    weights that are not 0 and their signs, for which it is a linear system."""
    a, b = h + np.diag(l2 + 1e-12), h @ w - g
    if not l1.any():
        return np.linalg.solve(a, b)
    v = w.copy()
    for _ in range(ROUNDS):
        for _ in range(5):
            for j in range(len(w)):
                x = b[j] - a[j] @ v + a[j, j] * v[j]
                v[j] = np.sign(x) * max(abs(x) - l1[j], 0.0) / a[j, j]
        on = (v != 0) | (l1 == 0)
        u = np.zeros(len(w))
        u[on] = np.linalg.solve(a[np.ix_(on, on)], b[on] - l1[on] * np.sign(v[on]))
        if (np.sign(u) == np.sign(v))[l1 > 0].all() and (np.abs(b - a @ u)[~on] <= l1[~on] + 1e-10).all():
            return u
    return v


def fit_models(rows: DataFrame, d: int, mean: np.ndarray, sd: np.ndarray, models: list[tuple[float, float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """([intercept, weights] on the scaled features, steps taken) of each (regParam, elasticNetParam, maxIter, fold left out).
    ``rows``: c0.., label, fold. A feature with one value gets weight 0, as in Spark."""
    scale = np.where(sd > 0, sd, 1.0)
    used = np.concatenate([[True], sd > 0])
    per = np.concatenate([[0.0], 1 / scale])  # weight on a raw feature for a unit on the scaled one; no penalty on the intercept
    l1 = np.array([r * e * per for r, e, _, _ in models])
    l2 = np.array([r * (1 - e) * per**2 for r, e, _, _ in models])
    at = np.zeros((len(models), d + 1))  # the best point so far, with its objective, gradient and curvature
    best = [None] * len(models)
    trial, steps = at.copy(), np.zeros(len(models), int)
    moving = list(range(len(models)))
    while moving:
        sums = _sums(rows, d, mean, scale, trial[moving], np.array([models[m][3] for m in moving]))
        still = []
        for i, m in enumerate(moving):
            t = sums.get(i)
            if t is None or t[0] == 0:
                continue
            value = t[1] / t[0] + l1[m] @ np.abs(trial[m]) + l2[m] @ trial[m] ** 2 / 2
            if best[m] is not None and value > best[m] + 1e-14 * abs(best[m]):
                trial[m] = (trial[m] + at[m]) / 2
                if np.abs(trial[m] - at[m]).max() > TOLERANCE:
                    still.append(m)
                continue
            gain = np.inf if best[m] is None else best[m] - value
            at[m], best[m] = trial[m], value
            if gain <= TOLERANCE * max(abs(value), 1e-3) or steps[m] >= models[m][2]:
                continue
            g, h = t[2 : d + 3] / t[0], t[d + 3 :].reshape(d + 1, d + 1) / t[0]
            keep = np.flatnonzero(used)
            trial[m, keep] = _step(at[m, keep], g[keep], h[np.ix_(keep, keep)], l1[m, keep], l2[m, keep])
            steps[m] += 1
            if np.abs(trial[m] - at[m]).max() > TOLERANCE:
                still.append(m)
        moving = still
    return at, steps


def search(spark: SparkSession, df: DataFrame, features: list[str], draws: list[dict], key: str, folds: int = 5) -> DataFrame:
    """One row a draw (``C``, ``elasticNetParam``, ``maxIter``): mean and sd of the exact area under the curve over the test
    folds, best first. Folds without both labels give no score."""
    d = len(features)
    own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(features)]
    rows = materialize(spark, df.where(F.col("label").isNotNull()).select(*own, F.col("label").cast("double").alias("label"), fold_column(key, folds).cast("int").alias("fold")), "search-rows")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(f"c{i}").alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, sd = (np.array([stats[f"{k}{i}"] or 0.0 for i in range(d)]) for k in "ms")
    n = max(stats["n"], 1)
    # equal C and mix: the largest maxIter first; its model is the others', too, unless it took more steps than they may
    shared = sorted({(float(x["C"]), float(x.get("elasticNetParam", 0.0)), int(x.get("maxIter", 100))) for x in draws}, key=lambda s: (s[0], s[1], -s[2]))
    first = {s[:2]: s for s in reversed(shared)}
    fitted: dict[tuple, np.ndarray] = {}

    def fit(specs):
        models = [(1.0 / (c * n), e, limit, k) for c, e, limit in specs for k in range(folds)]
        w, steps = fit_models(rows, d, mean, sd, models)
        for i, s in enumerate(specs):
            fitted[s] = w[i * folds : (i + 1) * folds]
        return {s: int(steps[i * folds : (i + 1) * folds].max()) for i, s in enumerate(specs)}

    taken = fit(list(first.values()))
    rest = [s for s in shared if s not in taken]
    again = [s for s in rest if taken[first[s[:2]]] > s[2]]
    if again:
        fit(again)
    use = {s: s if s in fitted else first[s[:2]] for s in shared}
    specs = sorted(fitted)
    weights, scale = np.array([fitted[s] for s in specs]), np.where(sd > 0, sd, 1.0)  # spec x fold x (d + 1)

    def held_out(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                z, y, fold = _design(batch, d, mean, scale), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for k in np.unique(fold).tolist():
                    at = fold == k
                    margin, size = z[at] @ weights[:, k].T, int(at.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(specs), dtype=np.int32), size)), pa.array(np.full(size * len(specs), k, np.int32)), pa.array(margin.T.ravel()), pa.array(np.tile(y[at], len(specs))), pa.array(np.ones(size * len(specs), np.int64))], names=["spec", "fold", "score", "label", "n"])

    scores = rows.mapInArrow(held_out, "spec int, fold int, score double, label double, n long").withColumn("g", F.struct("spec", "fold"))
    auc: dict = {}
    for r in auc_by_group(scores).select("g.spec", "g.fold", "auc").where("auc is not null").orderBy("spec", "fold").collect():  # draws x folds rows
        auc.setdefault(specs[r["spec"]], []).append(r["auc"])
    out = []
    for i, x in enumerate(draws):
        own = auc.get(use[float(x["C"]), float(x.get("elasticNetParam", 0.0)), int(x.get("maxIter", 100))], [])
        out.append((i, json.dumps(x, sort_keys=True), float(np.mean(own)) if own else None, float(np.std(own)) if own else None))
    return spark.createDataFrame(out, "draw int, params string, mean_test_score double, std_test_score double").orderBy(F.desc("mean_test_score"), "draw")
