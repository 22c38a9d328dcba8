"""ML queries.

Models are judged by metric, not bit for bit, so most keys are rows-only checks;
the metric arithmetic itself (M5/M6) and the feature matrix are SQL-checked on
deterministic inputs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark.catalog import sql_text as Q
from trendspark.catalog.common import ve
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import text as TX
from trendspark.ml import ensemble as EN
from trendspark.ml import models as MD
from trendspark.ml import registry as RG
from trendspark.ml import tuning as TU
from trendspark.ml.split import hash_split_flag
from trendspark.session import materialize, scratch_path
from trendspark.sources import files as SRC
from trendspark.sources.adapters import texts

TEXT_FEATURES = ["title_char_count", "title_word_count", "clickbait_score", "title_positive_words",
                 "title_negative_words", "title_has_exclamation", "title_has_number", "title_caps_count",
                 "title_caps_percentage", "title_brackets_count", "title_has_special", "title_word_diversity",
                 "desc_char_count", "desc_word_count", "desc_hashtag_count", "desc_mention_count", "has_sponsor",
                 "has_music_credits"]
VIDEO_FEATURES = ["views", "likes", "comments", "duration_seconds", "tag_count", "hours_since_published"]


def text_frame(spark, sf):
    """M21 + J4 + J5: labelled texts with numeric title/description features, label = quality."""
    feats = TX.description_features("description")
    t = TX.with_title_features(texts(spark, sf, with_labels=True).where(F.col("quality").isNotNull()), "title")
    t = t.select("doc_id", F.col("quality").cast("double").alias("label"),
                 *[feats.get(f, F.col(f)).cast("double").alias(f) for f in TEXT_FEATURES])
    return materialize(spark, t.withColumn("is_test", hash_split_flag("doc_id", 0.2)), "text-features")


def video_frame(spark, sf):
    from trendspark.catalog.common import vf
    v = vf(spark, sf).select("video_id", "channel_id", *VIDEO_FEATURES, "engagement_score")
    v = MD.fill_numeric(v, VIDEO_FEATURES).withColumn("label", F.col("engagement_score"))
    # split by channel so one channel's items never sit on both sides
    return materialize(spark, v.withColumn("is_test", hash_split_flag("channel_id", 0.2)), "video-features")


def _split(df):
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


def _fit_classifiers(train, algorithms=MD.CLASSIFIERS):
    n = train.count()
    return MD.side_by_side(train.sparkSession, {a: lambda a=a: MD.fit(train, TEXT_FEATURES, MD.classifier(a, n_train=n)) for a in algorithms})


def _cls_metrics(model, test):
    pred = model.transform(test).withColumn("score", MD.positive_probability())
    return MD.classification_metrics(pred)


# ---------------------------------------------------------------------------------------------
_FM_SQL_COLS = [s for s in Q.title_features("title") + Q.description_features("description")
                if s.rsplit(" AS ", 1)[1] in TEXT_FEATURES]
SQL_FEATURE_MATRIX = with_views("texts") + f"""
SELECT doc_id, CAST(l.quality AS DOUBLE) AS label,
       {", ".join(f"CAST({s.rsplit(' AS ', 1)[0]} AS DOUBLE) AS {s.rsplit(' AS ', 1)[1]}" for s in _FM_SQL_COLS)},
       (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100) < 20 AS is_test
FROM texts JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
"""


@query("feature_matrix", SQL_FEATURE_MATRIX)
def feature_matrix(spark, sf):
    """M21 + S9 + S10 + P8: feature/target table written to the shared folder and read back."""  # noqa
    return text_frame(spark, sf)


@query("ml_classify")
def ml_classify(spark, sf):
    """M3 + M5: forest, boosting, logistic on labelled texts; test metrics per algorithm."""
    train, test = _split(text_frame(spark, sf))
    models = _fit_classifiers(train)
    out = None
    for name, m in MD.side_by_side(spark, {a: lambda m=m: _cls_metrics(m, test) for a, m in models.items()}).items():
        m = m.withColumn("algorithm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return rounded(out, 6)


@query("ml_regress")
def ml_regress(spark, sf):
    """M4 + M6: forest, boosting, ridge for engagement on videos, with the leakage guard."""
    data = video_frame(spark, sf)
    feats = MD.leakage_guard(data, VIDEO_FEATURES, "engagement_score")
    train, test = _split(data)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    out = None
    fit = lambda a: MD.fit(train, feats, MD.regressor(a, n_train=stats["n"], y_sd=stats["sd"], deep=True))
    for a, model in MD.side_by_side(spark, {a: lambda a=a: fit(a) for a in MD.REGRESSORS}).items():
        m = MD.regression_metrics(model.transform(test)).withColumn("algorithm", F.lit(a))
        out = m if out is None else out.unionByName(m)
    return rounded(out, 6)


@query("ml_cv_metrics")
def ml_cv_metrics(spark, sf):
    """5-fold metrics of the logistic model (per fold)."""
    train, _ = _split(text_frame(spark, sf))
    est = MD.classifier("logistic", n_train=train.count())
    return rounded(TU.cross_validate(spark, train, TEXT_FEATURES, est, "classification", "doc_id", 5), 6)


@query("ml_random_search")
def ml_random_search(spark, sf):
    """M9: 20 random draws x 5 folds over the logistic space, AUC, best first."""
    train, _ = _split(text_frame(spark, sf))
    est = MD.classifier("logistic", n_train=train.count())
    return TU.random_search(spark, train, TEXT_FEATURES, est, TU.LOGISTIC_SPACE, "classification", "doc_id",
                            n_iter=20, folds=5)


@query("ml_select")
def ml_select(spark, sf):
    """Top-10 features by forest importance and by univariate F-test."""
    train, _ = _split(text_frame(spark, sf))
    imp = TU.select_by_importance(train, TEXT_FEATURES, "classification", 10)
    uni = TU.select_univariate(train, TEXT_FEATURES, "classification", 10)
    rows = [("importance", i, f) for i, f in enumerate(imp)] + [("univariate", i, f) for i, f in enumerate(uni)]
    chosen = spark.createDataFrame(rows, "method string, rank int, feature string")
    path = scratch_path(spark, "selected-features")  # S17: the selected names as a text table
    SRC.write_table(chosen.select(F.concat_ws("\t", "method", F.col("rank").cast("string"), "feature")
                                  .alias("value")), path, fmt="text")
    back = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return back.select(F.col("p")[0].alias("method"), F.col("p")[1].cast("int").alias("rank"),
                       F.col("p")[2].alias("feature"))


@query("ml_select_recursive")
def ml_select_recursive(spark, sf):
    """M12 (recursive with 3-fold CV, step 4): mean CV score per subset size."""
    train, _ = _split(text_frame(spark, sf))
    _, hist = TU.select_recursive(spark, train, TEXT_FEATURES, "classification", "doc_id", min_features=2,
                                  step=4, folds=3)
    return rounded(hist, 6)


@query("ml_vote")
def ml_vote(spark, sf):
    """Soft voting over forest, boosting and logistic."""
    train, test = _split(text_frame(spark, sf))
    pred = EN.vote(test, _fit_classifiers(train), "classification")
    return rounded(MD.classification_metrics(pred), 6)


@query("ml_stack")
def ml_stack(spark, sf):
    """Out-of-fold stacking (forest + logistic -> logistic meta model)."""
    data = TU.with_folds(text_frame(spark, sf), "doc_id", 5)
    train, test = _split(data)
    n = train.count()
    base = {"random_forest": MD.classifier("random_forest"), "logistic": MD.classifier("logistic", n_train=n)}
    pred = EN.stack(train, test, TEXT_FEATURES, base, MD.classifier("logistic", n_train=n), "classification")
    pred = pred.withColumn("score", MD.positive_probability())
    return rounded(MD.classification_metrics(pred), 6)


def _trained_registry(spark, sf):
    train, test = _split(text_frame(spark, sf))
    root = scratch_path(spark, "models")
    models = _fit_classifiers(train)
    metrics = MD.side_by_side(spark, {a: lambda m=m: _cls_metrics(m, test).first().asDict() for a, m in models.items()})
    for name, model in models.items():
        m = metrics[name]
        RG.save_model(spark, root, model, f"quality_{name}", "quality", "classification",
                      {k: m[k] for k in ["accuracy", "precision", "recall", "f1", "auc"]}, TEXT_FEATURES)
    return root, test


@query("ml_score_all")
def ml_score_all(spark, sf):
    """M8 + M14 + S14 + S15: save models with metadata, load the registry, score every test row."""
    root, test = _trained_registry(spark, sf)
    reg = RG.load_registry(spark, root).collect()
    return rounded(RG.score_all(reg, root, test, "doc_id"), 6)


@query("ml_model_compare")
def ml_model_compare(spark, sf):
    """M16 + O8: registry metrics table, by target then AUC."""
    root, _ = _trained_registry(spark, sf)
    return rounded(RG.compare_models(RG.load_registry(spark, root), "classification"), 6)


@query("ml_importance_compare")
def ml_importance_compare(spark, sf):
    """M17 + J6 + F56 + O5: importances across models, missing = 0, top 10 by mean."""
    root, _ = _trained_registry(spark, sf)
    return rounded(RG.compare_importances(RG.load_registry(spark, root), 10), 6)


SENSITIVITY_DURATIONS = [60, 180, 300, 600, 900, 1200, 1800, 2700, 3600]


@query("ml_sensitivity")
def ml_sensitivity(spark, sf):
    """M18 + J8: vary duration over 9 values for every test video; mean predicted engagement."""
    data = video_frame(spark, sf)
    train, test = _split(data)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    model = MD.fit(train, VIDEO_FEATURES, MD.regressor("linear", n_train=stats["n"], y_sd=stats["sd"]))
    return rounded(RG.sensitivity(model, test.drop("label"), "duration_seconds", SENSITIVITY_DURATIONS,
                                  "regression"), 6)


# --- metric arithmetic on deterministic predictions (SQL-checked) -----------------------------
_PRED = "title_has_exclamation"
_SCORE = "title_word_diversity"
_TF = {s.rsplit(" AS ", 1)[1]: s.rsplit(" AS ", 1)[0] for s in Q.title_features("title")}
SQL_CLS_METRICS = with_views("texts") + f"""
, p AS (SELECT l.quality AS y, {_TF[_PRED]} AS yhat, {_TF[_SCORE]} AS s
        FROM texts JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
r AS (SELECT s, count(*) AS c, sum(y) AS pos FROM p GROUP BY s),
rk AS (SELECT s, c, pos, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS below FROM r),
a AS (SELECT (sum(pos * (below + (c + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0)
             / (sum(pos) * (sum(c) - sum(pos))) AS auc FROM rk)
SELECT count(*) AS n, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
       round(coalesce(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 END) * 1.0
             / nullif(sum(CASE WHEN yhat = 1 THEN 1 ELSE 0 END), 0), 0.0), 9) AS precision,
       round(coalesce(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 END) * 1.0
             / nullif(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END), 0), 0.0), 9) AS recall,
       round((SELECT auc FROM a), 9) AS auc
FROM p
"""


@query("metrics_fixed_predictions", SQL_CLS_METRICS)
def metrics_fixed_predictions(spark, sf):
    """M5 + A32 arithmetic: accuracy/precision/recall and exact AUC of a fixed rule on labelled texts."""
    feats = TX.title_features("title")
    t = texts(spark, sf, with_labels=True).where(F.col("quality").isNotNull()).select(
        F.col("quality").alias("label"), feats[_PRED].alias("prediction"), feats[_SCORE].alias("score"))
    m = MD.classification_metrics(t).select("n", "accuracy", "precision", "recall", "auc")
    return rounded(m, 9)


SQL_REG_METRICS = with_views("ve") + """
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 4) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
       round(avg(abs(p - y)), 6) AS mae, round(1 - avg((p - y) * (p - y)) / var_pop(y), 9) AS r2
FROM (SELECT CAST(likes AS DOUBLE) AS y, comments * 25.5 AS p FROM ve)
"""


@query("regression_metrics_fixed", SQL_REG_METRICS)
def regression_metrics_fixed(spark, sf):
    """M6 + A32 arithmetic: mse/rmse/mae/r2 of a fixed linear rule (likes from comments)."""
    v = ve(spark, sf).select(F.col("likes").cast("double").alias("label"),
                             (F.col("comments") * 25.5).alias("prediction"))
    m = MD.regression_metrics(v)
    return m.select("n", F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"),
                    F.round("mae", 6).alias("mae"), F.round("r2", 9).alias("r2"))


@query("predict_potential")
def predict_potential(spark, sf):
    """M19 + F16-F22 + F52 + F54: full prediction record per request - a logistic model on the serving
    feature row gives the viral probability; heuristic score, blend, estimates, advice and
    recommendations are column expressions over the scored table."""
    from trendspark.functions import scoring as SC
    from trendspark.sources.adapters import requests
    feats = SC.serving_features()
    names = [f"f_{n}" for n in feats]  # feature-row columns, kept apart from the request fields
    req = requests(spark, sf)
    lab = spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    table = materialize(spark, req.join(lab, "doc_id", "left").select(
        "doc_id", "title", "description", "tags", "category_id", "duration_seconds", "publish_hour",
        "publish_weekday", F.col("quality").cast("double").alias("label"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in feats.items()]),
        "requests-scored-input")
    train = table.where(F.col("label").isNotNull())
    model = MD.fit(train, names, MD.classifier("logistic", n_train=train.count()))
    scored = model.transform(table).withColumn("viral_probability", MD.positive_probability())
    s = scored.withColumn("heuristic", SC.heuristic_score(F.length(F.coalesce("title", F.lit(""))),
                                                          "duration_seconds", "category_id", F.size("tags")))
    s = s.withColumn("trending_score", SC.blend_probability("heuristic", "viral_probability"))
    s = s.withColumn("engagement_estimate", SC.engagement_estimate("trending_score"))
    s = s.withColumn("potential_score", SC.combined_score("engagement_estimate", "viral_probability"))
    out = s.select(
        "doc_id", F.bround("trending_score", 1).alias("trending_score"),
        F.bround("engagement_estimate", 1).alias("engagement_score"),
        F.bround("viral_probability", 3).alias("viral_potential"),
        F.bround("potential_score", 1).alias("potential_score"),
        SC.views_estimate("trending_score").alias("views_estimate"),
        SC.views_estimate_100("potential_score").alias("views_estimate_100"),
        SC.advice_tier("trending_score").alias("advice_tier"),
        SC.recommendations_predictor("title", "description", F.size("tags"), "category_id", "duration_seconds",
                                     "publish_hour", "publish_weekday").alias("recommendations"))
    return out
