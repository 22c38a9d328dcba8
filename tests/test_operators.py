"""Distributed custom operators against brute force on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendspark.ml import models as MD
from trendspark.operators import aggregates as AG
from trendspark.operators import stats as ST
from trendspark.operators import windows as W


def test_exact_quantile_matches_numpy(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 3 else rnd.random() * 100 for i in range(3000)]
    vals += [42.0] * 1500  # one hot value holding a third of the rows
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for p in (0.25, 0.5, 0.75, 0.9):
        got = ST.exact_quantile(df, "x", p, buckets=16, final_rows=100)
        assert got == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12)


def test_global_percent_rank_matches_pandas(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    got = {r["id"]: r["pr"] for r in W.global_percent_rank(df, "v", "pr", partitions=5).collect()}
    s = pd.Series(vals)
    expected = (s.rank(method="min") - 1) / (len(s) - 1)
    for i, e in enumerate(expected):
        assert got[i] == pytest.approx(e)


def test_argmax_per_group_ties_smallest(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 5.0), ("a", 2, 1.0), ("b", 3, 2.0)], "g string, k int, m double")
    got = {r["g"]: r["k"] for r in W.argmax_per_group(df, "g", "m", "k").collect()}
    assert got == {"a": 0, "b": 3}


def test_best_by_equal_means_smallest_key(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.5)], "h int, e double")
    assert AG.best_by(df, "h", "e").first()["h"] == 1


def test_quartile_ties_included(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 3, 3, 3, 4]], "x double")
    from trendspark.ml.targets import create_targets
    t = create_targets(df.withColumnRenamed("x", "engagement_score"), ["is_highly_engaging"])
    assert t.agg(F.sum("is_highly_engaging")).first()[0] == 5  # q75 = 3.0, '>=' keeps ties


def test_auc_exact_with_ties(spark):
    data = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.4, 0)]
    df = spark.createDataFrame(data, "s double, y int")
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    got = spark.range(1).select(MD.auc_exact(df, "s", "y").alias("a")).first()["a"]
    assert got == pytest.approx(brute)


def test_leakage_guard_drops_target_copies(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2 + 1, float((i * 7) % 5)) for i in range(50)],
                               "engagement_score double, copy double, other double")
    assert MD.leakage_guard(df, ["copy", "other", "engagement_score_norm"], "engagement_score") == ["other"]


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    out = {(r["col_a"], r["col_b"]): r["corr"] for r in ST.correlation_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "a")] == 1.0 and out[("a", "b")] is None and out[("b", "b")] is None


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]], "x double")
    got = {r["bin"]: r["count"] for r in ST.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 4: 1}


def test_grouped_exact_quantiles_hot_group(spark):
    rnd = random.Random(11)
    rows = [("hot", rnd.random() * 10) for _ in range(3000)] + [("g%d" % (i % 5), float(i % 17)) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = ST.exact_quantiles_by_group(df, "g", "x", [0.25, 0.5, 0.75], buckets=8, final_rows=50)
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, grp in pdf.groupby("g"):
        exp = np.percentile(grp["x"], [25, 50, 75])
        assert got[g] == pytest.approx(list(exp), rel=1e-12)


def test_skew_safe_lag_matches_window(spark):
    from pyspark.sql import Window
    from trendspark.streaming import progression as PG
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 else "k%d" % (i % 7), i * 10 + rnd.randint(0, 5), float(rnd.randint(0, 100)))
            for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, t long, views double").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = PG.snapshot_deltas(df, ["k"], "ts", "id", values=["views"], partitions=6)
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.withColumn("views_delta", (F.col("views") - F.lag("views").over(w)).cast("double"))
    a = sorted((r["id"], r["views_delta"]) for r in got.select("id", "views_delta").collect())
    b = sorted((r["id"], r["views_delta"]) for r in ref.select("id", "views_delta").collect())
    assert a == b


def test_vote_leaves_the_members_as_they_are(spark):
    from pyspark.ml.classification import LogisticRegression

    from trendspark.ml import ensemble
    from trendspark.ml import models as MD

    rows = spark.createDataFrame([(float(i), float(i % 7), float(i > 20)) for i in range(40)], "x double, y double, label double")
    members = {"a": MD.fit(rows, ["x", "y"], LogisticRegression(maxIter=5)), "b": MD.fit(rows, ["x"], LogisticRegression(maxIter=5))}
    before = members["a"].transform(rows).columns
    voted = ensemble.vote(rows, members, "classification")
    assert {"score_a", "score_b", "score", "prediction"} <= set(voted.columns) and voted.count() == 40
    assert members["a"].transform(rows).columns == before


def test_category_pulls_of_all_categories_are_unioned(spark):
    import __spark_entry__ as E
    from trendspark.sources.adapters import videos

    from conftest import SF_SMALL
    rows = E.queries()["region_union_all_categories"](spark, SF_SMALL)
    assert rows.count() == 2 * videos(spark, SF_SMALL).count()
    assert rows.where("pull = 'category'").select("category_id").distinct().count() > 1


def test_channel_mean_of_a_small_table(spark):
    from trendspark.plans.features import channel_features

    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "video_id long, channel_id string, engagement_score double")
    rows = {r["video_id"]: (r["channel_avg_engagement"], r["relative_engagement"]) for r in channel_features(df).collect()}
    assert rows == {1: (2.0, 0.5), 2: (2.0, 1.5), 3: (5.0, 1.0)}
    assert channel_features(df, min_rows=100).where("channel_avg_engagement is not null").count() == 0


def test_channel_whose_scores_are_all_zero(spark):
    import math

    from trendspark.plans.features import channel_features

    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (3, "b", 2.0), (4, "b", 6.0), (5, "c", None)], "video_id int, channel_id string, engagement_score double")
    got = {r["video_id"]: r for r in channel_features(df).collect()}
    assert got[1]["channel_avg_engagement"] == 0.0 and math.isnan(got[1]["relative_engagement"]) and math.isnan(got[2]["relative_engagement"])
    assert got[3]["relative_engagement"] == 0.5 and got[4]["relative_engagement"] == 1.5 and got[5]["relative_engagement"] is None
