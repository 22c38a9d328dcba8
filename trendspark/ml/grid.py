"""Train every (target x algorithm) cell over one written feature table, restartably.

Cells run side by side as Spark jobs of their own (a bounded number of driver threads, which only wait).
Each cell writes its model and metadata (``registry``), its selected features and tuning results where
asked for, and last its status row, all under its own key. The features are put together as vectors once for all
cells, which take their own values out of them. A failing cell writes its error as its
status and the others go on. A rerun over the same folder skips the cells that are done with the same
settings and runs the others again, so a lost driver costs the cells in flight. An ensemble cell averages
the members of its target (soft vote, or mean value) and needs no fit of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.ml import ensemble as EN
from trendspark.ml import gram as GR
from trendspark.ml import models as MD
from trendspark.ml import prefix as PX
from trendspark.ml import registry as RG
from trendspark.ml import tuning as TU
from trendspark.session import materialize
from trendspark.sources import files as SRC

CLASSIFICATION_TARGETS = ["is_viral", "is_highly_engaging", "is_long_trending"]
REGRESSION_TARGETS = ["engagement_score", "views_per_hour", "views_per_hour_log", "like_view_ratio"]
#: Model filters: the kinds they take, and the word that a target's name must hold by kind.
FILTERS = {
    "all": {"classification": "", "regression": ""}, "classification": {"classification": ""}, "regression": {"regression": ""},
    "viral": {"classification": "viral"}, "engagement": {"classification": "engaging", "regression": "engagement"},
    "views": {"regression": "views"},
}
STATUS = "cell string, target string, algorithm string, kind string, status string, error string, settings string, n_features int, params string, metrics map<string,double>"


@dataclass(frozen=True)
class Cell:
    target: str
    algorithm: str
    kind: str

    @property
    def key(self) -> str:
        return f"{self.target}_{self.algorithm}"


def cells(available: list[str], models: str = "all") -> list[Cell]:
    """The cells of the targets that exist, filtered by name."""
    wanted = FILTERS[models]
    out = []
    for kind, targets, algorithms in (("classification", CLASSIFICATION_TARGETS, MD.CLASSIFIERS), ("regression", REGRESSION_TARGETS, MD.REGRESSORS)):
        if kind in wanted:
            out += [Cell(t, a, kind) for t in targets if t in available and wanted[kind] in t for a in algorithms]
    return out


@dataclass
class Settings:
    """What decides a cell's result; its digest tells whether a finished cell is still valid."""

    features: list[str]
    derived_from: dict[str, list[str]] = field(default_factory=dict)  # target -> features that hold it
    params: dict[str, dict] = field(default_factory=dict)  # algorithm -> estimator parameters
    select: int | None = None  # number of features to select by importance
    search: Callable | None = None  # (train, features, cell, key) -> (parameters, tuning result or None)
    search_name: str | None = None
    key: str = "id"

    def digest(self, cell: Cell) -> str:
        spec = [self.allowed(cell.target), self.params.get(cell.algorithm, {}), self.select, self.search_name]
        return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def allowed(self, target: str) -> list[str]:
        return [f for f in self.features if f not in self.derived_from.get(target, ())]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """The status rows under ``root``, one for each cell that ever ended."""
    if not _exists(spark, f"{root}/cells"):
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(STATUS).json(f"{root}/cells/*/*.txt")


def _write_status(spark: SparkSession, root: str, cell: Cell, **values) -> None:
    row = {"cell": cell.key, "target": cell.target, "algorithm": cell.algorithm, "kind": cell.kind} | values
    text = spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{root}/cells/{cell.key}")


def _estimator(cell: Cell, train: DataFrame, params: dict):
    if cell.kind == "classification":
        return MD.classifier(cell.algorithm, n_train=train.count(), **params)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    return MD.regressor(cell.algorithm, n_train=stats["n"], y_sd=stats["sd"], **params)


def _metrics(cell: Cell, scored: DataFrame) -> dict:
    if cell.kind == "classification":
        score = F.col("score") if "score" in scored.columns else MD.positive_probability()
        few = materialize(scored.sparkSession, scored.select("label", "prediction", score.alias("score")), "scored")  # read several times
        row = MD.classification_metrics(few).first()
    else:
        row = MD.regression_metrics(scored).first()
    return {k: float(v) for k, v in row.asDict().items() if v is not None}


def _vectors(table: DataFrame, wanted: list[Cell], s: Settings) -> DataFrame:
    return MD.with_vector(table, s.features, ["is_test", *dict.fromkeys(c.target for c in wanted)])


def _labelled(rows: DataFrame, cell: Cell) -> DataFrame:
    return rows.where(F.col(cell.target).isNotNull()).withColumn("label", F.col(cell.target).cast("double"))


def _run_cell(spark: SparkSession, table: DataFrame, vectors: DataFrame, cell: Cell, root: str, s: Settings) -> None:
    digest = s.digest(cell)
    try:
        train = _labelled(table, cell).where(~F.col("is_test"))
        features = s.allowed(cell.target)
        if s.select:
            features = TU.select_by_importance(train, features, cell.kind, s.select)
            chosen = spark.createDataFrame([(f,) for f in features], "value string").coalesce(1)
            SRC.write_table(chosen, f"{root}/selected/{cell.key}", fmt="text")
        params, tuned = dict(s.params.get(cell.algorithm, {})), None
        if s.search is not None:
            found, tuned = s.search(train, features, cell, s.key)
            params |= found
        if tuned is not None:
            SRC.write_table(tuned, f"{root}/tuning/{cell.key}", fmt="json")
        picked = MD.picker(s.features, features).transform(_labelled(vectors, cell)).select("is_test", "label", "features")
        model = MD.fit(picked.where(~F.col("is_test")), features, _estimator(cell, picked.where(~F.col("is_test")), params))
        metrics = _metrics(cell, model.stages[-1].transform(picked.where(F.col("is_test"))))
        RG.save_model(spark, f"{root}/models", model, cell.key, cell.target, cell.kind, metrics, features)
        _write_status(spark, root, cell, status="done", settings=digest, n_features=len(features), params=json.dumps(params, sort_keys=True), metrics=metrics)
    except Exception as e:  # the other cells go on; the error is the cell's result
        _write_status(spark, root, cell, status="failed", settings=digest, error=f"{type(e).__name__}: {e}"[:500])


def _run_ensemble(spark: SparkSession, vectors: DataFrame, target: str, kind: str, members: list[str], root: str, s: Settings, digest: str) -> None:
    cell = Cell(target, "ensemble", kind)
    try:
        test = _labelled(vectors, cell).where(F.col("is_test"))
        loaded = {m: RG.load_model(f"{root}/models", m) for m in members}
        picked = {m: PipelineModel([MD.picker(s.features, model.stages[0].getInputCols()), model.stages[-1]]) for m, model in loaded.items()}
        voted = EN.vote(test, picked, kind)
        _write_status(spark, root, cell, status="done", settings=digest, params=json.dumps(members), metrics=_metrics(cell, voted))
    except Exception as e:
        _write_status(spark, root, cell, status="failed", settings=digest, error=f"{type(e).__name__}: {e}"[:500])


def searcher(n_iter: int = 20, folds: int = 5, spaces: dict[str, dict] | None = None) -> Callable:
    """A ``Settings.search`` that tunes each algorithm by its own method: ridge by fold sums, forests and
    boosting by shared prefixes, logistic by cross-validated draws."""
    spaces = {"random_forest": TU.FOREST_SPACE, "gradient_boosting": TU.BOOSTING_SPACE, "logistic": TU.LOGISTIC_SPACE} | (spaces or {})

    def search(train: DataFrame, features: list[str], cell: Cell, key: str) -> tuple[dict, DataFrame]:
        spark = train.sparkSession
        if cell.algorithm == "linear":
            table, _, best = GR.search(spark, train, features, "label", key, n_iter, folds)
            params = {"alpha": best["alpha"], "fitIntercept": best["fit_intercept"]}
        elif cell.algorithm == "logistic":
            table = TU.random_search(spark, train, features, MD.classifier("logistic", n_train=train.count()), spaces["logistic"], cell.kind, key, n_iter, folds)
            params = best = json.loads(table.first()["params"])
        else:
            table, _, best = PX.search(spark, train, features, cell.algorithm, cell.kind, key, TU.draw_params(spaces[cell.algorithm], n_iter), folds)
            params = best
        return params, TU.tuning_record(table, best)

    return search


def train_all(spark: SparkSession, table: DataFrame, wanted: list[Cell], root: str, settings: Settings, ensemble: bool = False,
              parallelism: int = 4) -> DataFrame:
    """Run the ``wanted`` cells that are not done yet; the status rows of all of them. ``table``: a written
    table with the features, the targets, the row key and the flag ``is_test``."""
    done = {r["cell"]: r["settings"] for r in statuses(spark, root).where("status = 'done'").select("cell", "settings").collect()}
    todo = [c for c in wanted if done.get(c.key) != settings.digest(c)]
    vectors = _vectors(table, wanted, settings) if todo else None
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        # wrapped once for each cell: its thread has local properties of its own
        for job in [pool.submit(inheritable_thread_target(spark)(_run_cell), spark, table, vectors, c, root, settings) for c in todo]:
            job.result()
    keys = [c.key for c in wanted]
    if ensemble:
        ended = {r["cell"]: r for r in statuses(spark, root).where(F.col("cell").isin(keys)).collect()}
        for target, kind in dict.fromkeys((c.target, c.kind) for c in wanted):
            members = sorted(c.key for c in wanted if c.target == target and c.key in ended and ended[c.key]["status"] == "done")
            digest = hashlib.sha256(json.dumps([(m, ended[m]["settings"]) for m in members]).encode()).hexdigest()[:16]
            key = f"{target}_ensemble"
            if len(members) > 1:
                keys.append(key)
                if done.get(key) != digest or any(c.key in members for c in todo):
                    vectors = vectors or _vectors(table, wanted, settings)
                    _run_ensemble(spark, vectors, target, kind, members, root, settings, digest)
    return statuses(spark, root).where(F.col("cell").isin(keys))
