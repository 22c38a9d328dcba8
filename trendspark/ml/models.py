"""Feature assembly, leakage guard, estimators and metrics.

Estimator defaults follow the analysed application: forest 100 trees with
sqrt feature sampling (depth capped at Spark's maximum, 30), boosting 100
rounds / step 0.1 / depth 3 / sqrt features, logistic C=1 (L2, stopping
tolerance 1e-4 as in the original's library), ridge alpha=1.
sklearn's C and alpha are mapped to Spark's regParam on the training set
(logistic: 1/(C n); ridge: alpha * sd(y) / n, both without standardization).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.ml.deep_forest import DeepForestRegressor
from trendspark.operators.stats import safe_corr
from trendspark.operators.windows import value_ranks
from trendspark.session import materialize

CLASSIFIERS = ["random_forest", "gradient_boosting", "logistic"]
# Deep forests (the original grows trees without a depth limit): a larger per-pass node
# budget means fewer passes over the data per level, and cached node ids avoid
# re-descending every tree for every row at each level (measured 338 s -> 88 s).
DEEP_TREE_OPTIONS = {"maxMemoryInMB": 1024, "cacheNodeIds": True}
REGRESSORS = ["random_forest", "gradient_boosting", "linear"]


# --- features ------------------------------------------------------------------------------

def leakage_guard(df: DataFrame, features: list[str], target: str, threshold: float = 0.999) -> list[str]:
    """Drop features named after the target or almost perfectly correlated with it.

    One aggregate computes every |corr(feature, target)|; constant features give null.
    """
    named = [f for f in features if target not in f]
    if not named:
        return []
    row = df.agg(*[safe_corr(f, target).alias(f) for f in named]).first()
    return [f for f in named if row[f] is None or abs(row[f]) <= threshold]


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    """missing values -> 0 is done before; 'keep' makes NaN survive instead of failing."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def fill_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """coerce each feature to double, null -> 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


# --- estimators ----------------------------------------------------------------------------

def classifier(algorithm: str, n_train: int | None = None, label: str = "label", seed: int = 42, **params):
    if algorithm == "random_forest":
        est = RandomForestClassifier(numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt",
                                     minInstancesPerNode=1, seed=seed, **DEEP_TREE_OPTIONS)
    elif algorithm == "gradient_boosting":
        est = GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, featureSubsetStrategy="sqrt", seed=seed)
    elif algorithm == "logistic":
        c = params.pop("C", 1.0)
        est = LogisticRegression(regParam=1.0 / (c * max(n_train or 1, 1)), elasticNetParam=0.0,
                                 standardization=False, maxIter=100, tol=1e-4)
    else:
        raise ValueError(f"unknown classifier {algorithm}")
    est.setLabelCol(label).setFeaturesCol("features")
    return est.setParams(**params) if params else est


def regressor(algorithm: str, n_train: int | None = None, y_sd: float | None = None, label: str = "label",
              seed: int = 42, deep: bool = False, **params):
    """``deep``: the forest is grown in tasks and kept as a table (``deep_forest``), for trees whose nodes no driver holds."""
    if algorithm == "random_forest" and deep:
        return DeepForestRegressor(seed=seed, **params).setLabelCol(label).setFeaturesCol("features")
    if algorithm == "random_forest":
        est = RandomForestRegressor(numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt",
                                    minInstancesPerNode=1, seed=seed, **DEEP_TREE_OPTIONS)
    elif algorithm == "gradient_boosting":
        est = GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, featureSubsetStrategy="sqrt", seed=seed)
    elif algorithm == "linear":
        alpha = params.pop("alpha", 1.0)
        est = LinearRegression(regParam=alpha * (y_sd or 1.0) / max(n_train or 1, 1), elasticNetParam=0.0,
                               standardization=False, solver="normal")
    else:
        raise ValueError(f"unknown regressor {algorithm}")
    est.setLabelCol(label).setFeaturesCol("features")
    return est.setParams(**params) if params else est


def fit(df: DataFrame, features: list[str], estimator) -> PipelineModel:
    """M3/M4: assemble + estimator as one pipeline, so serving applies the same transform (D10). Rows that hold the vector
    ``features`` already (``picker``) are fitted as they are; the model assembles it from the columns all the same."""
    if "features" in df.columns:
        return PipelineModel([assembler(features), estimator.fit(df)])
    return Pipeline(stages=[assembler(features), estimator]).fit(df)


def with_vector(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the vector ``every`` of all ``features``, written once: a fit reads its rows many times, and to put a
    vector together from many columns is most of a reading."""
    return materialize(df.sparkSession, assembler(features, "every").transform(df).select(*keep, "every"), "vectors")


def picker(features: list[str], own: list[str]) -> VectorSlicer:
    """``features`` with the values of ``own`` out of ``every`` of ``with_vector``."""
    at = {f: i for i, f in enumerate(features)}
    return VectorSlicer(inputCol="every", outputCol="features", indices=[at[f] for f in own])


def side_by_side(spark: SparkSession, jobs: dict[str, Callable], width: int = 4) -> dict:
    """The results of independent jobs (fits, metrics), at most ``width`` at once: each is many short Spark jobs with a
    wait in between, so that alone none keeps the cores busy. The driver's threads only wait."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: job.result() for name, job in started.items()}


def positive_probability(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


# --- metrics -------------------------------------------------------------------------------

def auc_exact(df: DataFrame, score: str, label: str) -> Column:
    """Exact ROC AUC (ties count one half) as a scalar: Mann-Whitney U from distributed ranks."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("long")).alias("_p"))
    ranks = value_ranks(df, score)
    j = counts.join(ranks, score)
    s = j.agg(F.sum(F.col("_p") * (F.col("rows_below") + (F.col("_c") + 1) / 2.0)).alias("rs"),
              F.sum("_p").alias("p"), F.sum("_c").alias("n"))
    auc = s.select(F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0,
                                F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))
    return auc.scalar()


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = "score") -> DataFrame:
    """M5: accuracy, precision, recall, F1 (zero_division = 0) and AUC in one row."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
                 F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
                 F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
                 F.sum((y == p).cast("long")).alias("correct"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = c.select("n", (F.col("correct") / F.col("n")).alias("accuracy"), prec.alias("precision"),
                   rec.alias("recall"))
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    if score is not None:
        out = out.withColumn("auc", auc_exact(pred.select(F.col(score).alias("_s"), F.col(label).alias("_y")),
                                              "_s", "_y"))
    return out


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6: mse, rmse, mae, r2 in one aggregate (r2 from the label's total sum of squares)."""
    err = F.col(prediction) - F.col(label)
    s = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                 F.var_pop(label).alias("var_y"))
    return s.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("var_y") > 0, 1 - F.col("mse") / F.col("var_y")).alias("r2"))


def feature_importances(model: PipelineModel, features: list[str], top_n: int | None = 20) -> list[tuple[str, float]]:
    """M7: tree importances or |coefficients|, sorted (model metadata, a bounded list)."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    pairs = sorted(zip(features, vals), key=lambda kv: (-kv[1], kv[0]))
    return pairs[:top_n] if top_n else pairs
