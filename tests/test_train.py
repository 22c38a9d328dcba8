"""The wide feature table, the train-all grid, ridge by fold sums, shared prefixes of tree ensembles, scoring with
errors by target, the leakage guard by lineage."""

import json
import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from trendspark.ml import deep_forest as DF
from trendspark.ml import feature_table as FT
from trendspark.ml import gram as GR
from trendspark.ml import grid as GD
from trendspark.ml import lineage as LN
from trendspark.ml import models as MD
from trendspark.ml import prefix as PX
from trendspark.ml import registry as RG
from trendspark.ml import tuning as TU
from trendspark.sources import files as SRC


def folder():
    return tempfile.mkdtemp(prefix="trendspark-test-")


@pytest.fixture(scope="module")
def points(spark):
    """(id, a, b, c, y, label, is_test): 240 rows, written once."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(240, 3)) * [1, 50, 0.1] + [5, 1000, 0]
    y = 2 * x[:, 0] - 0.01 * x[:, 1] + draw.normal(size=240)
    rows = [(i, *map(float, x[i]), float(y[i]), float(y[i] > np.median(y)), bool(i % 5 == 0)) for i in range(240)]
    path = f"{folder()}/points"
    spark.createDataFrame(rows, "id long, a double, b double, c double, y double, label double, is_test boolean").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


# --- feature table ------------------------------------------------------------------------------

KIND = "video_id long, title string, category_id string, channel_id long, views long, likes long, comments long, duration_seconds long, tag_count int, publish_time timestamp_ntz"


def videos(spark, rows):
    import datetime as dt
    when = dt.datetime(2024, 3, 2, 18, 30)
    return spark.createDataFrame([(i, t, c, ch, v, 3, 1, d, 2, when) for i, t, c, ch, v, d in rows], KIND)


def test_parameters_are_learned_once_and_applied_alike(spark):
    train = videos(spark, [(1, "Amazing 10 TIPS!", "10", 7, 100, 30), (2, "plain", "20", 7, 300, 4000), (3, None, "10", 8, 0, 600)])
    root = folder()
    fitted = FT.fit(FT.row_features(train, ["video_id"]), root)
    assert fitted.vocabulary["category"] == ["10", "20"]
    assert len(fitted.columns) == len(set(c.lower() for c in fitted.columns))
    back = FT.FittedFeatures.load(spark, root)
    assert back.columns == fitted.columns and back.moments == fitted.moments
    new = videos(spark, [(9, "Amazing 10 TIPS!", "99", 7, 100, 30), (10, "x", "10", 55, 200, 30)])
    a, b = (r.asDict() for r in back.transform(FT.row_features(new, ["video_id"]), ["video_id"]).orderBy("video_id").collect())
    assert a["category_10"] == a["category_20"] == 0.0 and b["category_10"] == 1.0  # an unseen category is all zeros
    assert a["channel_video_count"] == 2.0 and b["channel_video_count"] == 0.0
    mean, sd = np.mean([100, 300, 0]), np.std([100, 300, 0], ddof=1)
    assert a["views_norm"] == pytest.approx((100 - mean) / sd) and b["views_norm"] == pytest.approx((200 - mean) / sd)
    assert a["clickbait_score"] == 1.0 and a["title_caps_count"] == 1.0 and a["publish_evening"] == 1.0 and a["publish_weekend"] == 1.0
    assert a["duration_very_short"] == 1.0 and a["duration_bin_very_short"] == 1.0 and a["publish_dayofweek"] == 5.0
    assert b["relative_engagement"] == pytest.approx(b["engagement_score"])


def test_absent_and_null_inputs_are_zero(spark):
    fitted = FT.fit(FT.row_features(videos(spark, [(1, "a", "1", 1, 10, 60), (2, "b", "2", 2, 20, 90)]), ["video_id"]), folder())
    for asked in (spark.createDataFrame([(1, "hello")], "id long, title string"), spark.createDataFrame([(1, None, None, "many")], "id long, title string, category_id string, views string")):
        row = fitted.transform(FT.row_features(asked, ["id"]), ["id"]).first().asDict()
        assert set(row) == {"id", *fitted.columns} and all(v is not None for v in row.values())
        assert row["views_log"] == row["publish_hour"] == row["category_1"] == row["channel_video_count"] == 0.0
    assert fitted.transform(FT.row_features(videos(spark, []), ["video_id"]), ["video_id"]).count() == 0


def test_columns_of_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(FT, "MOST_VALUES", 2)
    with pytest.raises(ValueError, match="category_id"):
        FT.fit(FT.row_features(videos(spark, [(i, "a", str(i), 1, 1, 1) for i in range(3)]), ["video_id"]), folder())


# --- ridge --------------------------------------------------------------------------------------

def plain_ridge(x, y, alpha, fit_intercept):
    if not fit_intercept:
        return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y), 0.0
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_ridge_search_equals_refitting_every_fold(spark, points):
    table, model, best = GR.search(spark, points, ["a", "b", "c"], "y", "id", n_iter=20, folds=5)
    rows = TU.with_folds(points, "id", 5).collect()
    x, y = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.y for r in rows])
    fold = np.array([r.fold for r in rows])
    found = table.collect()
    assert len(found) == 20 and {json.loads(r.params)["fit_intercept"] for r in found} == {True, False}
    for r in found:
        spec = json.loads(r.params)
        test, train = [], []
        for k in range(5):
            own = fold == k
            w, b = plain_ridge(x[~own], y[~own], spec["alpha"], spec["fit_intercept"])
            for part, out in ((own, test), (~own, train)):
                out.append(-np.sqrt(np.mean((x[part] @ w + b - y[part]) ** 2)))
        assert r.mean_test_score == pytest.approx(np.mean(test), rel=1e-9) and r.mean_train_score == pytest.approx(np.mean(train), rel=1e-9)
        assert r.std_test_score == pytest.approx(np.std(test), rel=1e-7)
    assert found[0].mean_test_score == max(r.mean_test_score for r in found) and json.loads(found[0].params) == best
    w, b = plain_ridge(x, y, best["alpha"], best["fit_intercept"])
    assert model.weights == pytest.approx(w.tolist(), rel=1e-9) and model.intercept == pytest.approx(b, rel=1e-9, abs=1e-9)
    got = points.select(model.column().alias("p"), "a", "b", "c").first()
    assert got.p == pytest.approx(float(np.array([got.a, got.b, got.c]) @ w + b))


def test_ridge_sums_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 4.0, None)], "id long, a double, y double")
    (sums,) = GR.fold_sums(df, ["a"], "y", F.lit(0), 1)
    assert sums.n == 2 and sums._raw()[1, 2] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        GR.search(spark, df.limit(1), ["a"], "y", "id")


# --- prefixes of tree ensembles -------------------------------------------------------------------

def arrays(points):
    rows = points.select("a", "b", "c").collect()
    return np.array([[r.a, r.b, r.c] for r in rows])


@pytest.fixture(scope="module")
def vectors(points):
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(points)


def test_boosting_prefix_is_the_model_of_fewer_rounds(spark, points, vectors):
    x = arrays(points)
    for make, kind in ((GBTClassifier, "classification"), (GBTRegressor, "regression")):
        label = "label" if kind == "classification" else "y"
        whole = make(maxIter=6, maxDepth=3, seed=5, labelCol=label).fit(vectors)
        scores = PX.Trees.of(spark, whole, "gradient_boosting", kind).prefixes(x, [2, 4, 6])
        for j, k in enumerate((2, 4, 6)):
            cut = make(maxIter=k, maxDepth=3, seed=5, labelCol=label).fit(vectors).transform(vectors)
            want = [r[0] for r in cut.select(vector_to_array("rawPrediction")[1] if kind == "classification" else "prediction").collect()]
            assert scores[:, j] == pytest.approx(want, abs=1e-9)


def test_forest_prefix_is_the_mean_of_its_first_trees(spark, points, vectors):
    x = arrays(points)
    for make, kind, label in ((RandomForestClassifier, "classification", "label"), (RandomForestRegressor, "regression", "y")):
        forest = make(numTrees=5, maxDepth=6, seed=2, labelCol=label).fit(vectors)
        scores = PX.Trees.of(spark, forest, "random_forest", kind).prefixes(x, [1, 3, 5, 9])
        out = (lambda m: vector_to_array("probability")[1]) if kind == "classification" else (lambda m: F.col("prediction"))
        each = np.array([[r[0] for r in t.transform(vectors).select(out(t)).collect()] for t in forest.trees])
        whole = [r[0] for r in forest.transform(vectors).select(out(forest)).collect()]
        for j, k in enumerate((1, 3, 5, 5)):
            assert scores[:, j] == pytest.approx(each[:k].mean(axis=0).tolist(), abs=1e-9)
        assert scores[:, 2] == pytest.approx(whole, abs=1e-9)


def test_auc_by_group_equals_pairs(spark):
    draw = np.random.default_rng(1)
    rows = [(g, float(s), float(y), int(n)) for g in range(3) for s, y, n in zip(draw.choice([-9, -1, 0, 0.25, 0.5, 3, 40], 60), draw.integers(0, 2, 60), draw.integers(1, 4, 60), strict=True)]
    rows += [(7, 1.0, 1.0, 2)]
    found = {r.g: r.auc for r in PX.auc_by_group(spark.createDataFrame(rows, "g int, score double, label double, n long")).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        pos, neg = ([(s, n) for _, s, y, n in own if y == v] for v in (1.0, 0.0))
        won = sum(m * n * ((p > q) + 0.5 * (p == q)) for p, m in pos for q, n in neg)
        assert found[g] == pytest.approx(won / (sum(n for _, n in pos) * sum(n for _, n in neg)))
    assert found[7] is None


def test_search_shares_fits_among_prefixes(spark, points, monkeypatch):
    fits = []
    real = MD.classifier
    monkeypatch.setattr(MD, "classifier", lambda a, **p: fits.append(p) or real(a, **p))
    draws = [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 5, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 3}, {"maxIter": 5, "maxDepth": 2}]
    table, model, best = PX.search(spark, points, ["a", "b", "c"], "gradient_boosting", "classification", "id", draws, folds=2)
    assert len(fits) == 2 * 2 + 1  # two settings, two folds, and the best draw on all rows
    rows = {r.draw: r for r in table.collect()}
    assert rows[1].mean_test_score == rows[3].mean_test_score and all(0.5 < r.mean_test_score <= r.mean_train_score + 0.2 for r in rows.values())
    root = folder()
    SRC.write_table(TU.tuning_record(table, best), f"{root}/t", fmt="json")
    back = SRC.read_tuning_results(spark, f"{root}/t/*.json").first()
    assert back.best_score == pytest.approx(max(r.mean_test_score for r in rows.values())) and len(back.params) == 4
    assert back.mean_test_score[2] == pytest.approx(rows[2].mean_test_score) and back.params[0] == {"maxIter": "2", "maxDepth": "2"}
    value, _, _ = PX.search(spark, points.withColumn("label", F.col("y")), ["a", "b", "c"], "random_forest", "regression", "id", [{"numTrees": 3, "maxDepth": 3}], folds=2)
    assert value.first().mean_test_score < 0


# --- the grid -------------------------------------------------------------------------------------

def grid_table(points):
    return points.withColumnsRenamed({"y": "engagement_score", "label": "is_viral"}).withColumn("views_per_hour", F.lit(None).cast("double"))


def test_cells_are_filtered_by_name():
    every = GD.CLASSIFICATION_TARGETS + GD.REGRESSION_TARGETS
    assert len(GD.cells(every)) == 21 and GD.cells(["other"]) == []
    assert {c.target for c in GD.cells(every, "viral")} == {"is_viral"} and {c.target for c in GD.cells(every, "views")} == {"views_per_hour", "views_per_hour_log"}
    assert {c.target for c in GD.cells(every, "engagement")} == {"is_highly_engaging", "engagement_score"}
    assert {c.kind for c in GD.cells(every, "regression")} == {"regression"}


def test_a_killed_cell_is_recorded_and_rerun_alone(spark, points, monkeypatch):
    table, root = grid_table(points), folder()
    wanted = [GD.Cell("is_viral", "logistic", "classification"), GD.Cell("engagement_score", "linear", "regression"), GD.Cell("is_viral", "gradient_boosting", "classification")]
    params = {"gradient_boosting": {"maxIter": 3, "maxDepth": 2}}
    settings = GD.Settings(["a", "b", "c"], {"engagement_score": ["c"]}, params, key="id")
    fits, real = [], MD.fit

    def killed(df, features, estimator):
        fits.append((type(estimator).__name__, tuple(features)))
        if type(estimator).__name__ == "LinearRegression" and len(fits) <= 3:
            raise RuntimeError("the executor is gone")
        return real(df, features, estimator)

    monkeypatch.setattr(MD, "fit", killed)
    first = {r.cell: r for r in GD.train_all(spark, table, wanted, root, settings).collect()}
    assert {c: r.status for c, r in first.items()} == {"is_viral_logistic": "done", "engagement_score_linear": "failed", "is_viral_gradient_boosting": "done"}
    assert "the executor is gone" in first["engagement_score_linear"].error and first["is_viral_logistic"].metrics["auc"] > 0.8
    assert len(fits) == 3 and ("LinearRegression", ("a", "b")) in fits
    again = {r.cell: r for r in GD.train_all(spark, table, wanted, root, settings, ensemble=True).collect()}
    assert fits[3:] == [("LinearRegression", ("a", "b"))]  # only the cell that failed
    assert {r.status for r in again.values()} == {"done"} and again["engagement_score_linear"].metrics["r2"] > 0.5
    assert set(again) == {*first, "is_viral_ensemble"} and again["is_viral_ensemble"].metrics["auc"] > 0.8
    GD.train_all(spark, table, wanted, root, settings, ensemble=True)
    assert len(fits) == 4
    changed = GD.Settings(["a", "b", "c"], {"engagement_score": ["c"]}, {"gradient_boosting": {"maxIter": 2, "maxDepth": 2}}, key="id")
    GD.train_all(spark, table, wanted, root, changed)
    assert [f[0] for f in fits[4:]] == ["GBTClassifier"]  # other settings, another model
    registry = RG.load_registry(spark, f"{root}/models")
    assert {r.model_name for r in registry.collect()} == {c.key for c in wanted}


def test_tuned_and_selected_cells(spark, points):
    table, root = grid_table(points), folder()
    search = GD.searcher(n_iter=2, folds=2, spaces={"gradient_boosting": {"maxIter": [2, 3], "maxDepth": [2]}})
    wanted = [GD.Cell("engagement_score", "linear", "regression"), GD.Cell("is_viral", "gradient_boosting", "classification"), GD.Cell("views_per_hour", "linear", "regression")]
    out = {r.cell: r for r in GD.train_all(spark, table, wanted, root, GD.Settings(["a", "b", "c"], search=search, search_name="small", key="id")).collect()}
    assert out["engagement_score_linear"].status == "done" and "alpha" in json.loads(out["engagement_score_linear"].params)
    assert out["is_viral_gradient_boosting"].status == "done" and out["views_per_hour_linear"].status == "failed"  # no row has the target
    assert SRC.read_tuning_results(spark, f"{root}/tuning/*/*.json").count() == 2


# --- scoring with errors by target -------------------------------------------------------------------

def test_a_damaged_model_is_one_error_row(spark, points):
    root = folder()
    for name, est, kind, label in (("good", MD.classifier("logistic", n_train=200), "classification", "label"), ("value", MD.regressor("linear", 200, 1.0), "regression", "y"), ("bad", MD.regressor("linear", 200, 1.0), "regression", "y")):
        model = MD.fit(points.withColumn("label", F.col(label)), ["a", "b", "c"], est)
        RG.save_model(spark, root, model, name, f"t_{name}", kind, {}, ["a", "b", "c"])
    import glob
    for f in glob.glob(f"{root}/bad/model/stages/*/data/part-*"):
        with open(f, "wb") as out:
            out.write(b"damaged")
    registry = RG.load_registry(spark, root)
    rows = RG.score_each(registry, root, points.drop("c", "label"), "id").collect()  # an absent feature is 0
    errors = [r for r in rows if r.error]
    assert [(r.model_name, r.target_name, r.id, r.prediction) for r in errors] == [("bad", "t_bad", None, None)]
    assert sum(r.model_name == "good" for r in rows) == sum(r.model_name == "value" for r in rows) == 240
    assert all(0 <= r.probability <= 1 for r in rows if r.model_name == "good") and all(r.probability is None for r in rows if r.model_name == "value")
    assert RG.score_each(registry.where("false"), root, points, "id").count() == 0


# --- lineage ----------------------------------------------------------------------------------------

def test_features_that_share_a_base_column_leak(spark, points):
    df = points.withColumn("score", F.col("a") * 2 + F.col("b")).withColumn("copy", F.col("score") / 10).withColumn("half", F.sqrt(F.abs("a")))
    means = df.groupBy((F.col("id") % 7).alias("g")).agg(F.avg("score").alias("g_mean"), F.count(F.lit(1)).alias("g_n"))
    df = df.withColumn("g", F.col("id") % 7).join(means, "g").withColumn("other", F.col("c") + 1)
    df = df.select("*", F.explode(F.array("b", "c")).alias("either")).unionByName(df.withColumn("either", F.lit(0.0)))
    of = LN.base_columns(df)
    assert of["copy"] == {"a", "b"} and of["half"] == {"a"} and of["other"] == {"c"} and of["g_mean"] == {"a", "b"} and of["either"] >= {"b", "c"}
    names = ["a", "b", "c", "copy", "half", "other", "g_mean", "g_n", "either"]
    assert LN.leaking(df, "score", names) == ["a", "b", "copy", "half", "g_mean", "either"]
    assert LN.leaking(df, "score", names, known_before=("b",)) == ["a", "copy", "half", "g_mean"]
    path = f"{folder()}/m"
    means.write.parquet(path)
    stored = points.withColumn("g", F.col("id") % 7).join(spark.read.parquet(path), "g").withColumn("score", F.col("a") * 2)
    assert LN.leaking(stored, "score", ["g_mean", "c"]) == [] and LN.leaking(stored, "score", ["g_mean", "c"], learned={"g_mean": ["a"]}) == ["g_mean"]


def test_logistic_search_equals_fits_of_each_draw(spark, points):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from trendspark.ml import logit as LG

    rows = points.drop("label").withColumn("label", (F.col("y") > 0).cast("double")).withColumn("same", F.lit(3.0))
    own = ["a", "b", "c", "same"]
    draws = [{"C": 1, "elasticNetParam": 0.0, "maxIter": 100}, {"C": 0.1, "elasticNetParam": 1.0, "maxIter": 500}, {"C": 10, "elasticNetParam": 0.5, "maxIter": 100}, {"C": 1, "elasticNetParam": 0.0, "maxIter": 2000}]
    found = {r["draw"]: r for r in LG.search(spark, rows, own, draws, "id", 3).collect()}
    data = TU.with_folds(rows, "id", 3)
    for i, d in enumerate(draws):
        scores = []
        for k in range(3):
            est = MD.classifier("logistic", n_train=data.count(), C=d["C"], elasticNetParam=d["elasticNetParam"], maxIter=2000, tol=1e-10)
            pred = MD.fit(data.where(F.col("fold") != k), own, est).transform(data.where(F.col("fold") == k))
            pred = pred.withColumn("score", vector_to_array("rawPrediction")[1])
            scores.append(MD.classification_metrics(pred).first()["auc"])
        assert found[i]["mean_test_score"] == pytest.approx(np.mean(scores), abs=1e-3)
        assert found[i]["std_test_score"] == pytest.approx(np.std(scores), abs=1e-3)


def test_shared_logistic_fits_have_sparks_weights(spark, points):
    from trendspark.ml import logit as LG

    rows = points.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate("abc")], (F.col("y") > 0).cast("double").alias("label"), F.lit(0).alias("fold"))
    s = rows.agg(*[f(f"c{i}") for i in range(3) for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = np.array(s[0::2]), np.array(s[1::2])
    models = [(0.01, 0.0, 100, -1), (0.02, 1.0, 100, -1), (0.01, 0.5, 100, -1)]
    w, steps = LG.fit_models(rows, 3, mean, sd, models)
    for (reg, mix, _, _), own in zip(models, w):
        est = MD.classifier("logistic", regParam=reg, elasticNetParam=mix, maxIter=2000, tol=1e-12)
        model = MD.fit(rows, ["c0", "c1", "c2"], est).stages[-1]
        assert own[1:] / sd == pytest.approx(model.coefficients.toArray(), rel=2e-3, abs=1e-5)
        assert own[0] - (own[1:] / sd) @ mean == pytest.approx(model.intercept, rel=2e-3, abs=1e-3)
    assert steps.max() < 30


def test_a_search_of_logistic_draws_makes_no_fit_of_its_own(spark, points, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(LogisticRegression, "_fit", lambda *a: pytest.fail("a fit for one draw"))
    found = TU.random_search(spark, points.withColumn("label", (F.col("y") > 0).cast("double")), ["a", "b"], MD.classifier("logistic", n_train=240), TU.LOGISTIC_SPACE, "classification", "id", 6, 3)
    assert found.count() == 6 and 0.5 < found.first()["mean_test_score"] <= 1


def test_titles_are_made_once_and_varied_rows_keep_them(spark, monkeypatch):
    rows = videos(spark, [(1, "Amazing 10 TIPS! (best)", "10", 7, 100, 30), (2, "", "20", 7, 300, 4000), (3, None, "10", 8, 0, 600), (4, " A  étÉ a_b WIN!? a ", "1", 8, 5, 90)])
    own = FT.row_features(rows, ["video_id"])
    names = sorted(own.columns)
    titled = FT.with_titles(rows).drop("title")
    assert own.select(names).exceptAll(FT.row_features(titled, ["video_id"], titled=True).select(names)).count() == 0
    from trendspark.functions import text as TX
    plain = TX.title_features("title")
    assert rows.select("video_id", *[c.alias(n) for n, c in plain.items()]).exceptAll(TX.with_title_features(rows).select("video_id", *plain)).count() == 0


def test_whole_numbers_round_alike(spark):
    from trendspark.catalog.registry import rounded

    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.0, -3.0, 0.1234567, -0.00000001, 1e300, float("inf"), None)], "x double")
    assert rounded(df, 6, often_whole=True).exceptAll(rounded(df, 6)).count() == 0


def test_a_table_small_in_bytes_uses_all_cores(spark):
    from trendspark.session import materialize

    cores = spark.sparkContext.defaultParallelism
    assert materialize(spark, spark.range(40000).repartition(8), "rows").rdd.getNumPartitions() == cores
    assert materialize(spark, spark.range(40).repartition(8), "rows").rdd.getNumPartitions() == 1


def test_independent_fits_run_side_by_side(spark):
    import threading

    both = threading.Barrier(2, timeout=30)
    assert set(MD.side_by_side(spark, {"a": both.wait, "b": both.wait})) == {"a", "b"}


# --- deep forests ---------------------------------------------------------------------------------

def test_a_tree_of_the_deep_forest_is_sparks(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(0, 12, size=(600, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * (x[:, 2] > 5) + draw.normal(size=600)
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(600)], "id long, a double, b double, c double, label double").cache()
    found = []
    for est in (DF.DeepForestRegressor(numTrees=1, maxDepth=4, featureSubsetStrategy="all", bootstrap=False), DecisionTreeRegressor(maxDepth=4)):
        found.append(MD.fit(rows, ["a", "b", "c"], est).transform(rows).orderBy("id").select("prediction").toPandas().prediction.to_numpy())
    assert len(set(found[0])) > 10 and np.allclose(*found)


def test_a_deep_forest_does_not_depend_on_where_its_nodes_are_split(spark, points, monkeypatch):
    train = points.where("not is_test").withColumn("label", F.col("y"))
    asked = points.withColumn("a", F.when(F.col("id") == 7, float("nan")).otherwise(F.col("a")))
    found = {}
    for local in (1000, 40):  # rows of the largest node that one task may finish
        monkeypatch.setattr(DF, "LOCAL", local)
        model = MD.fit(train, ["a", "b", "c"], MD.regressor("random_forest", deep=True, numTrees=7))
        forest = model.stages[-1]
        sizes = [r for top in forest.tops for r in top.rows if r]
        assert max(sizes) <= local and forest.subtrees(spark).count() == len(sizes)
        found[local] = model.transform(asked).orderBy("id").select("id", "y", "prediction").toPandas()
    assert len(sizes) > 7 and found[40].id.tolist() == list(range(240))
    assert np.allclose(found[1000].prediction, found[40].prediction)
    assert np.corrcoef(found[40].prediction, found[40].y)[0, 1] > 0.8


def test_the_deep_forest_takes_odd_tables(spark):
    rows = spark.createDataFrame([(float(i % 2), 1.0, 5.0) for i in range(10)], "a double, b double, label double")
    est = MD.regressor("random_forest", deep=True, numTrees=3)
    model = MD.fit(rows, ["a", "b"], est)
    assert {r["prediction"] for r in model.transform(rows).collect()} == {5.0}
    assert model.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        MD.fit(rows.limit(0), ["a", "b"], est)


# --- vectors written once -------------------------------------------------------------------------

def test_cells_take_their_features_out_of_vectors_written_once(spark, points, monkeypatch):
    table, root = grid_table(points), folder()
    made, fitted, real = [], [], MD.fit
    with_vector = MD.with_vector
    monkeypatch.setattr(MD, "with_vector", lambda *a: made.append(a[1]) or with_vector(*a))
    monkeypatch.setattr(MD, "fit", lambda df, features, est: fitted.append((df.columns, tuple(features))) or real(df, features, est))
    wanted = [GD.Cell("engagement_score", a, "regression") for a in ("linear", "random_forest")] + [GD.Cell("is_viral", "logistic", "classification")]
    s = GD.Settings(["a", "b", "c"], {"engagement_score": ["b"]}, {"random_forest": {"numTrees": 3, "maxDepth": 3}}, key="id")
    out = {r.cell: r for r in GD.train_all(spark, table, wanted, root, s, ensemble=True).collect()}
    assert {r.status for r in out.values()} == {"done"} and made == [["a", "b", "c"]]
    assert sorted(f for _, f in fitted) == [("a", "b", "c"), ("a", "c"), ("a", "c")] and all("features" in c for c, _ in fitted)
    # the stored models take named columns, and give the metrics that a fit on named columns gives
    rows = table.where("engagement_score is not null").withColumn("label", F.col("engagement_score").cast("double"))
    model = RG.load_model(f"{root}/models", "engagement_score_linear")
    assert model.stages[0].getInputCols() == ["a", "c"]
    plain = MD.regression_metrics(real(rows.where("not is_test"), ["a", "c"], GD._estimator(wanted[0], rows.where("not is_test"), {})).transform(rows.where("is_test"))).first()
    stored = MD.regression_metrics(model.transform(rows.where("is_test"))).first()
    assert plain["mse"] == pytest.approx(stored["mse"], rel=1e-9) == out["engagement_score_linear"].metrics["mse"]


def test_a_search_puts_its_vectors_together_once(spark, points, monkeypatch):
    made, with_vector = [], MD.with_vector
    monkeypatch.setattr(MD, "with_vector", lambda *a: made.append(a[1]) or with_vector(*a))
    rows = PX.prepared(points, ["a", "b", "c"], "id", 2)
    for algorithm, draws in (("random_forest", [{"numTrees": 2, "maxDepth": 2}, {"numTrees": 4, "maxDepth": 3}]), ("gradient_boosting", [{"maxIter": 2, "maxDepth": 2}])):
        found, model, _ = PX.search(spark, points, ["a", "b", "c"], algorithm, "classification", "id", draws, folds=2, rows=rows)
        assert found.count() == len(draws) and model.transform(points).count() == 240
    assert len(made) == 1


def test_trees_are_walked_once_for_a_score(spark, points):
    rows = PX.prepared(points, ["a", "b"], "id", 2)
    model = MD.classifier("random_forest", numTrees=3, maxDepth=2).fit(rows)
    scored = PX._scored(rows, PX.Trees.of(spark, model, "random_forest", "classification"), 0, [1, 3], "classification")
    assert scored.count() == 4
    assert "MapInArrow" not in scored._jdf.queryExecution().optimizedPlan().toString()  # walked already, read from what was written


def test_leaks_of_many_targets_read_a_plan_once(spark, points, monkeypatch):
    df = points.select("a", "b", (F.col("a") + 1).alias("t"), (F.col("b") * 2).alias("u"))
    read, base = [], LN.base_columns
    monkeypatch.setattr(LN, "base_columns", lambda d: read.append(1) or base(d))
    assert LN.leaking_each(df, ["t", "u"], ["a", "b"]) == {"t": ["a"], "u": ["b"]} and len(read) == 1
