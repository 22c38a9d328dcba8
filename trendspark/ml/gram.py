"""M9 for ridge regression: the whole search from one Gram matrix for each fold.

One scan adds up, for each fold, the products of [1, features, target]. The training sums of a fold are
the total minus that fold's, so every (alpha, intercept, fold) is a small linear system and its errors are
quadratic forms of the sums: 20 draws x 5 folds cost the scan and not 100 fits, with training scores.

Columns are shifted by their means first (one aggregate), which keeps the sums well-conditioned. Each task
holds folds x (d + 2)^2 numbers, rows of which are added by (fold, row) in a shuffle of that size; the driver
gets the folds' matrices. Rows with a null target take no part, null features count as 0.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.ml.split import fold_column

#: FIXED VALUES: search space of the ridge model.
RIDGE_SPACE = {"alpha": [0.0001, 0.001, 0.01, 0.1, 1, 10, 100], "fit_intercept": [True, False]}


@dataclass
class Sums:
    """Sums of products of [1, x, y], of which ``shift`` was taken off x and y."""

    matrix: np.ndarray
    shift: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.matrix - other.matrix, self.shift)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def ridge(self, alpha: float, fit_intercept: bool = True) -> tuple[np.ndarray, float]:
        """(weights, intercept) that minimise the squared error plus alpha times the squared weights."""
        if fit_intercept:
            g, s = self.matrix, self.matrix[0]
            centred = g[1:, 1:] - np.outer(s[1:], s[1:]) / s[0]
            w = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(s) - 2), centred[:-1, -1])
            means = self.shift + s[1:] / s[0]
            return w, float(means[-1] - means[:-1] @ w)
        raw = self._raw()
        return np.linalg.solve(raw[1:-1, 1:-1] + alpha * np.eye(len(raw) - 2), raw[1:-1, -1]), 0.0

    def _raw(self) -> np.ndarray:
        back = np.eye(len(self.matrix))
        back[1:, 0] = self.shift
        return back @ self.matrix @ back.T

    def squared_error(self, w: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a model over the rows of these sums."""
        constant = intercept + self.shift[:-1] @ w - self.shift[-1]
        v = np.concatenate([[constant], w, [-1.0]])
        return max(0.0, float(v @ self.matrix @ v))


def fold_sums(df: DataFrame, features: list[str], label: str, fold: Column, folds: int) -> list[Sums]:
    """The sums of each fold's rows."""
    own = [*features, label]
    rows = df.where(F.col(label).isNotNull()).select(fold.cast("int").alias("fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(own)])
    means = rows.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(own))]).first()
    shift = np.array([v or 0.0 for v in means])
    d = len(own)
    schema = "fold int, line int, total array<double>"

    def products(batches):
        import pyarrow as pa

        sums = np.zeros((folds, d + 1, d + 1))
        for batch in batches:
            at = batch.column("fold").to_numpy()
            z = np.ones((len(at), d + 1))
            for i in range(d):
                z[:, i + 1] = batch.column(f"c{i}").to_numpy() - shift[i]
            for k in np.unique(at).tolist():
                own = z[at == k]
                sums[k] += own.T @ own
        kept = [k for k in range(folds) if sums[k, 0, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kept, d + 1), pa.int32()), pa.array(list(range(d + 1)) * len(kept), pa.int32()), pa.array([line for k in kept for line in sums[k]], pa.list_(pa.float64()))], names=["fold", "line", "total"])

    def added(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for k, i, line in zip(*(batch.column(c).to_pylist() for c in ("fold", "line", "total")), strict=True):
                total[k, i] = total.get((k, i), 0.0) + np.array(line)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["fold", "line", "total"])

    out = np.zeros((folds, d + 1, d + 1))
    for r in rows.mapInArrow(products, schema).repartition("fold", "line").mapInArrow(added, schema).collect():
        out[r["fold"], r["line"]] = r["total"]
    return [Sums(m, shift) for m in out]


def draws(n_iter: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in RIDGE_SPACE.items()} for _ in range(n_iter)]


@dataclass
class RidgeModel:
    """A fitted ridge model as a column expression."""

    features: list[str]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        terms = (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in zip(self.features, self.weights, strict=True))
        return sum(terms, F.lit(self.intercept))


def search(spark: SparkSession, df: DataFrame, features: list[str], label: str, key: str, n_iter: int = 20, folds: int = 5, seed: int = 42) -> tuple[DataFrame, RidgeModel, dict]:
    """M9: (one row a draw with mean and sd of the negative RMSE over test folds and its mean over training
    folds, best first; the best draw fitted to all rows; its parameters). Equal draws are scored once."""
    parts = fold_sums(df, features, label, fold_column(key, folds), folds)
    total = Sums(sum(p.matrix for p in parts), parts[0].shift)
    used = [p for p in parts if p.n and p.n < total.n]
    if not used:
        raise ValueError("fewer than two folds have rows")
    rows, wanted = [], draws(n_iter, seed)
    scored: dict[tuple, tuple] = {}
    for i, draw in enumerate(wanted):
        spec = (draw["alpha"], draw["fit_intercept"])
        if spec not in scored:
            test, train = [], []
            for part in used:
                rest = total - part
                w, b = rest.ridge(*spec)
                test.append(-np.sqrt(part.squared_error(w, b) / part.n))
                train.append(-np.sqrt(rest.squared_error(w, b) / rest.n))
            scored[spec] = float(np.mean(test)), float(np.std(test)), float(np.mean(train))
        rows.append((i, json.dumps(draw, sort_keys=True), *scored[spec]))
    best = wanted[max(rows, key=lambda r: (r[2], -r[0]))[0]]
    w, b = total.ridge(best["alpha"], best["fit_intercept"])
    table = spark.createDataFrame(rows, "draw int, params string, mean_test_score double, std_test_score double, mean_train_score double")
    return table.orderBy(F.desc("mean_test_score"), "draw"), RidgeModel(list(features), w.tolist(), b), best
