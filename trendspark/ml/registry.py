"""Model registry: save/load with metadata, score with every model, compare.

A model is a fitted ``PipelineModel`` (assembler + estimator) written to the
shared folder; its metadata row (name, target, kind, metrics, top importances,
features) is written next to it as JSON and read back with one glob (S14).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.ml import models as MD
from trendspark.operators.lookups import importance_outer
from trendspark.sources.files import read_model_metadata


def save_model(spark: SparkSession, root: str, model: PipelineModel, name: str, target: str, kind: str,
               metrics: dict, features: list[str]) -> str:
    """M8 + S15: model files + one metadata JSON (top-20 importances, metrics, feature list)."""
    path = f"{root}/{name}"
    model.write().overwrite().save(f"{path}/model")
    meta = {
        "model_name": name, "target_name": target, "model_type": kind,
        "creation_time": dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S"),
        "metrics": {k: float(v) for k, v in metrics.items() if v is not None},
        "feature_importances": dict(MD.feature_importances(model, features, top_n=20)),
        "features": features,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata")
    return path


def load_registry(spark: SparkSession, root: str) -> DataFrame:
    """Every metadata file under ``root`` as one table."""
    return read_model_metadata(spark, f"{root}/*/metadata/*.txt")


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/{name}/model")


def score_all(registry_rows: list, root: str, df: DataFrame, key: str) -> DataFrame:
    """Score ``df`` with every registered model -> long (key, model, target, kind, prediction,
    probability). The registry is metadata (a handful of rows); scoring is distributed."""
    parts = []
    for r in registry_rows:
        model = load_model(root, r["model_name"])
        pred = model.transform(df)
        prob = MD.positive_probability() if r["model_type"] == "classification" else F.lit(None).cast("double")
        parts.append(pred.select(key, F.lit(r["model_name"]).alias("model_name"),
                                 F.lit(r["target_name"]).alias("target_name"),
                                 F.lit(r["model_type"]).alias("model_type"),
                                 F.col("prediction").cast("double").alias("prediction"),
                                 prob.alias("probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SCORED = "model_name string, target_name string, model_type string, prediction double, probability double, error string"


def score_each(registry: DataFrame, root: str, df: DataFrame, key: str) -> DataFrame:
    """M14 with errors by target: every usable model scores ``df`` in one scan (each adds its columns to
    the same projection), features that ``df`` lacks are 0 (F55); a model that cannot be loaded or applied
    gives one row with its error and a null key. An empty registry gives no rows."""
    spark = df.sparkSession
    rows = registry.select("model_name", "target_name", "model_type", "features").collect()  # metadata, a row a model
    lacking = sorted({f for r in rows for f in r["features"] or []} - set(df.columns))
    out, usable, errors = df.withColumns({f: F.lit(0.0) for f in lacking}), [], []
    for i, r in enumerate(rows):
        try:
            model = load_model(root, r["model_name"])
            last = model.stages[-1]
            names = {p: f"_{i}_{p}" for p in ("predictionCol", "probabilityCol", "rawPredictionCol") if last.hasParam(p)}
            for p, name in names.items():
                last.set(last.getParam(p), name)
            own = model.transform(out)
            prob = MD.positive_probability(names["probabilityCol"]) if r["model_type"] == "classification" else F.lit(None).cast("double")
            own = own.withColumns({f"_{i}_prediction": F.col(names["predictionCol"]).cast("double"), f"_{i}_score": prob})
            out = own.drop("features", *[n for n in names.values()])
            usable.append((i, r))
        except Exception as e:
            errors.append((r["model_name"], r["target_name"], r["model_type"], None, None, f"{type(e).__name__}: {e}"[:300]))
    kind = df.schema[key].dataType.simpleString()
    failed = spark.createDataFrame(errors, SCORED).select(F.lit(None).cast(kind).alias(key), "*")
    if not usable:
        return failed
    each = F.array(*[F.struct(F.lit(r["model_name"]).alias("model_name"), F.lit(r["target_name"]).alias("target_name"), F.lit(r["model_type"]).alias("model_type"),
                              F.col(f"_{i}_prediction").alias("prediction"), F.col(f"_{i}_score").alias("probability"), F.lit(None).cast("string").alias("error")) for i, r in usable])
    return out.select(key, F.explode(each).alias("s")).select(key, "s.*").unionByName(failed)


def compare_models(registry: DataFrame, kind: str) -> DataFrame:
    """M16 + O8: metrics per model, sorted by target then the main metric (desc)."""
    if kind == "classification":
        names, main = ["accuracy", "precision", "recall", "f1", "auc"], "auc"
    else:
        names, main = ["mse", "rmse", "mae", "r2"], "r2"
    reg = registry.where(F.col("model_type") == kind)
    return (reg.select("model_name", "target_name", *[F.col("metrics")[m].alias(m) for m in names])
            .orderBy("target_name", F.desc(main), "model_name"))


def compare_importances(registry: DataFrame, top_n: int = 10) -> DataFrame:
    """M17 + J6 + F56: importances of all models side by side (missing = 0), by mean."""
    long = registry.select(F.col("model_name").alias("model"),
                           F.explode("feature_importances").alias("feature", "importance"))
    models = [r["model"] for r in long.select("model").distinct().orderBy("model").collect()]
    return importance_outer(long, models, top_n)


def sensitivity(model: PipelineModel, base: DataFrame, attribute: str, values: list, kind: str,
                prepare=None) -> DataFrame:
    """M18 + J8: every base record with ``attribute`` set to each value, scored.

    The value list is a fixed small parameter, so each record is expanded with
    ``explode`` of a literal array (no join)."""
    grid = base.withColumn(attribute, F.explode(F.array(*[F.lit(v) for v in values])))
    if prepare is not None:
        grid = prepare(grid)
    pred = model.transform(grid)
    out = MD.positive_probability() if kind == "classification" else F.col("prediction")
    return pred.groupBy(attribute).agg(F.avg(out).alias("mean_prediction"), F.count(F.lit(1)).alias("n"))
