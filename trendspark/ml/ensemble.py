"""Voting and stacking ensembles (M11, M13) as column arithmetic over scored frames.

Each member scores the same rows with its own output columns (no join), so a
voting ensemble is one projection over one DataFrame.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.ml import models as MD


def _rename_outputs(model: PipelineModel, suffix: str) -> PipelineModel:
    """A copy of ``model`` whose output columns end in ``suffix``; the caller's model stays as it is."""
    last = model.stages[-1].copy()
    for p in ("predictionCol", "probabilityCol", "rawPredictionCol"):
        if last.hasParam(p):
            last.set(last.getParam(p), f"{p.replace('Col', '')}_{suffix}")
    return PipelineModel([*model.stages[:-1], last])


def score_members(df: DataFrame, members: dict[str, PipelineModel], kind: str) -> DataFrame:
    """Apply every member; keep one score column per member (positive-class probability or value)."""
    out = df
    for name, model in members.items():
        scored = _rename_outputs(model, name).transform(out)
        vec = "features"
        if kind == "classification":
            scored = scored.withColumn(f"score_{name}", MD.positive_probability(f"probability_{name}"))
        else:
            scored = scored.withColumn(f"score_{name}", F.col(f"prediction_{name}"))
        out = scored.drop(vec, f"prediction_{name}", f"probability_{name}", f"rawPrediction_{name}")
    return out


def vote(df: DataFrame, members: dict[str, PipelineModel], kind: str, weights: dict[str, float] | None = None,
         threshold: float = 0.5) -> DataFrame:
    """Soft vote (weighted mean probability) or mean value."""
    w = weights or {n: 1.0 for n in members}
    total = sum(w.values())
    scored = score_members(df, members, kind)
    mean = sum((F.col(f"score_{n}") * w[n] for n in members), F.lit(0.0)) / total
    scored = scored.withColumn("score", mean)
    if kind == "classification":
        return scored.withColumn("prediction", (F.col("score") >= threshold).cast("double"))
    return scored.withColumn("prediction", F.col("score"))


def stack(train: DataFrame, test: DataFrame, features: list[str], base: dict, meta, kind: str,
          folds: int = 5) -> DataFrame:
    """Out-of-fold base scores on the training rows train the meta model; base models
    refit on all training rows score the test rows, which the meta model then combines.

    ``train`` must carry an integer ``fold`` column; ``base`` maps names to estimators."""
    parts = {k: train.where(F.col("fold") != k) for k in range(folds)} | {"all": train}
    fitted = MD.side_by_side(train.sparkSession, {(k, n): lambda p=p, est=est: MD.fit(p, features, est) for k, p in parts.items() for n, est in base.items()})
    oof_parts = [score_members(train.where(F.col("fold") == k), {n: fitted[k, n] for n in base}, kind) for k in range(folds)]
    oof = oof_parts[0]
    for p in oof_parts[1:]:
        oof = oof.unionByName(p)
    meta_cols = [f"score_{n}" for n in base]
    meta_model = MD.fit(oof, meta_cols, meta)
    full = {n: fitted["all", n] for n in base}
    return meta_model.transform(score_members(test, full, kind))
