"""Unit tests on hand-computed rows (fixture rows and edge rows of every F-operator)."""

import math

import pytest
from pyspark.sql import functions as F

from trendspark.functions import arrays as AR
from trendspark.functions import numeric as N
from trendspark.functions import scoring as SC
from trendspark.functions import temporal as TM
from trendspark.functions import text as TX
from trendspark.operators import lookups as J


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_two_row_fixture(spark):
    """The 2-row frame of the original smoke test, with hand-computed expectations."""
    df = spark.createDataFrame(
        [("vid1", "Sample Video 1", "2023-01-01T12:00:00Z", "2023-01-03T12:00:00Z", "1", 1000, 100, 50, "PT5M30S"),
         ("vid2", "Sample Video 2 with a question?", "2023-01-02T15:30:00Z", "2023-01-03T12:00:00Z", "10",
          2000, 250, 120, "PT12M45S")],
        "video_id string, title string, publish_time string, fetch_time string, category_id string, "
        "views long, likes long, comments long, duration string")
    df = df.withColumns({"publish_time": TM.parse_time("publish_time"), "fetch_time": TM.parse_time("fetch_time")})
    df = df.withColumns(N.engagement_columns())
    df = df.withColumn("hours", TM.hours_between("publish_time", "fetch_time"))
    df = df.withColumns({"secs": TM.iso_duration_seconds("duration"), "vph": N.per_hour("views", "hours"),
                         "delay": TM.delay_category("hours"), **TM.time_parts("publish_time")})
    df = df.withColumns({"dcat": N.duration_category("secs"), "tod": TM.time_of_day("publish_hour"),
                         "q": TX.has_literal("title", "?"), "num": TX.has_pattern("title", TX.DIGIT),
                         "wc": TX.word_count("title")})
    r = {x["video_id"]: x for x in rows(df)}
    assert r["vid1"]["secs"] == 330 and r["vid2"]["secs"] == 765
    assert r["vid1"]["dcat"] == "medium" and r["vid2"]["dcat"] == "medium"
    assert r["vid1"]["like_view_ratio"] == 10.0 and r["vid1"]["comment_view_ratio"] == 5.0
    assert r["vid2"]["like_view_ratio"] == 12.5 and r["vid2"]["comment_view_ratio"] == 6.0
    assert r["vid1"]["engagement_score"] == 35.0 and r["vid2"]["engagement_score"] == 42.5
    assert r["vid1"]["hours"] == 48.0 and r["vid2"]["hours"] == 20.5
    assert r["vid1"]["vph"] == pytest.approx(20.8333333) and r["vid2"]["vph"] == pytest.approx(97.5609756)
    assert r["vid1"]["delay"] == "same_week" and r["vid2"]["delay"] == "same_day"
    assert (r["vid1"]["publish_hour"], r["vid1"]["publish_weekday"], r["vid1"]["publish_weekend"]) == (12, 6, 1)
    assert (r["vid2"]["publish_hour"], r["vid2"]["publish_weekday"], r["vid2"]["publish_weekend"]) == (15, 0, 0)
    assert r["vid1"]["tod"] == "afternoon" and r["vid2"]["tod"] == "afternoon"
    assert (r["vid1"]["q"], r["vid1"]["num"], r["vid1"]["wc"]) == (0, 1, 3)
    assert (r["vid2"]["q"], r["vid2"]["num"], r["vid2"]["wc"]) == (1, 1, 6)


@pytest.mark.parametrize("text,secs", [(None, 0), ("PT15S", 15), ("PT2H", 7200), ("P1DT1H", 3600), ("", 0),
                                       ("PT5M30S", 330)])
def test_iso_duration(spark, text, secs):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(TM.iso_duration_seconds("d").alias("s")).first()["s"] == secs


def test_duration_and_title_bins(spark):
    secs = [0, 59, 60, 299, 300, 1199, 1200, 3599, 3600]
    df = spark.createDataFrame([(s,) for s in secs], "s long")
    got = [r["c"] for r in df.select(N.duration_category("s").alias("c")).collect()]
    assert got == ["very_short", "very_short", "short", "short", "medium", "medium", "long", "long", "very_long"]
    lens = [0, 20, 21, 160, 161]
    df = spark.createDataFrame([(n,) for n in lens], "n int")
    from trendspark import schema as S
    got = [r["b"] for r in df.select(N.bin_right_closed("n", S.TITLE_LENGTH_EDGES, S.TITLE_LENGTH_LABELS)
                                     .alias("b")).collect()]
    assert got == [None, "0-20", "21-40", "141-160", None]


def test_time_of_day_both_evening_ends(spark):
    hours = [4, 5, 11, 12, 16, 17, 20, 21, 22, 23]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    f = [r["t"] for r in df.select(TM.time_of_day("h", 22).alias("t")).collect()]
    s = [r["t"] for r in df.select(TM.time_of_day("h", 21).alias("t")).collect()]
    assert f == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "evening",
                 "night", "night"]
    assert s[7] == "night" and f[7] == "evening"


def test_engagement_edges(spark):
    df = spark.createDataFrame([(0, 5, 1, 0.0), (10, 50, 0, 1.0 / 7200), (100, 10, 1, None)],
                               "views long, likes long, comments long, hours double")
    out = rows(df.select(N.ratio_pct("likes", "views").alias("lvr"), N.per_hour("views", "hours").alias("vph"),
                         N.virality("views", "hours").alias("vir")))
    assert out[0]["lvr"] == 100.0            # views 0 -> floor 1, capped at 100
    assert out[1]["lvr"] == 100.0            # likes > views -> cap
    assert out[1]["vph"] == pytest.approx(600.0)  # hours below one minute -> 1/60
    assert out[2]["vph"] == 0.0 and out[2]["vir"] is None  # invalid time


@pytest.mark.parametrize("text,clean,words", [
    (None, "", 0), ("", "", 0), ("   ", "", 0),
    ("Über-COOL!! (2024) #1", "über cool 2024 1", 3),
    ("it's", "it s", 1), ("tab\there\nnew", "tab here new", 3), ("how  to", "how to", 2),
])
def test_clean_and_words(spark, text, clean, words):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(TX.clean_text("t").alias("c"), TX.word_count("t").alias("w")).first()
    assert r["c"] == clean and r["w"] == words


def test_title_flags(spark):
    df = spark.createDataFrame([("Part 3 of the 2024 TUTORIAL!! 😀",), ("pt. 2 review vs",), ("plain",)], "t string")
    feats = {**TX.title_features("t"), **TX.pattern_flags("t")}
    out = rows(df.select(*[c.alias(n) for n, c in feats.items()]))
    assert out[0]["title_has_part_number"] == 1 and out[0]["title_has_year"] == 1
    assert out[0]["title_has_tutorial"] == 1 and out[0]["title_has_emoji"] == 1
    assert out[0]["title_has_exclamation"] == 1 and out[0]["title_caps_count"] == 1
    assert out[1]["title_has_part_number"] == 1 and out[1]["title_has_review"] == 1
    assert all(out[2][k] == 0 for k in ["title_has_part_number", "title_has_year", "title_has_emoji"])


def test_lexicon_counts_duplicates(spark):
    df = spark.createDataFrame([("SHOCKING: amazing, great & awful news",)], "t string")
    c = TX.clean_text("t")
    from trendspark import schema as S
    r = df.select(TX.phrase_hits(c, S.CLICKBAIT_PHRASES).alias("cb"), TX.word_hits(c, S.POSITIVE_WORDS).alias("p"),
                  TX.word_hits(c, S.NEGATIVE_WORDS).alias("n")).first()
    assert r["cb"] == 3  # 'shocking' listed twice + 'amazing'
    assert (r["p"], r["n"]) == (2, 1)


@pytest.mark.parametrize("tags,expected", [(None, []), ("", []), ("a, b", ["a", "b"]), ('["a","b"]', ["a", "b"]),
                                           ("[broken", ["[broken"]), ("a|b", ["a|b"])])
def test_parse_tags(spark, tags, expected):
    df = spark.createDataFrame([(tags,)], "t string")
    assert df.select(AR.parse_tags("t").alias("x")).first()["x"] == expected


def test_category_lookup_unknown_and_null(spark):
    df = spark.createDataFrame([("23",), ("34",), ("99",), (None,)], "category_id string")
    got = [r["category_name"] for r in J.category_lookup(spark, df).orderBy(F.col("category_id").asc_nulls_last())
           .collect()]
    assert got == ["Comedy", "Comedy", "Unknown", "Unknown"]


def test_heuristic_score_and_advice(spark):
    df = spark.createDataFrame([("A" * 54, 900, "28", 5)], "title string, d long, c string, tags int")
    s = df.select(SC.heuristic_score(F.length("title"), "d", "c", "tags").alias("s")).first()["s"]
    assert s == pytest.approx(5 + 0.5 + 0.5 + 0.3 + 0.4)
    r = df.select(SC.views_estimate(F.lit(6.7)).alias("v"), SC.advice_tier(F.lit(6.7)).alias("a")).first()
    assert r["v"] == int(5000 * (2 ** 6.7 / 32)) and r["a"] == "good"


def test_zscore_constant_and_single(spark):
    from trendspark.operators.stats import with_zscores
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert [r["x_norm"] for r in with_zscores(df, ["x"]).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 3.0)], "id int, x double")
    assert with_zscores(one, ["x"]).first()["x_norm"] == 0.0


def test_cycles(spark):
    df = spark.createDataFrame([(6,)], "h int")
    r = df.select(TM.cycle("h", 24, "sin").alias("s"), TM.cycle("h", 24, "cos").alias("c")).first()
    assert r["s"] == pytest.approx(1.0) and abs(r["c"]) < 1e-12
    assert math.isclose(r["s"], math.sin(2 * math.pi * 6 / 24))
