"""Rule-based scoring queries over scoring requests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog import sql_text as Q
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import scoring as SC
from trendspark.functions import text as TX
from trendspark.sources.adapters import requests


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


_TITLE_F = (f"CASE WHEN title_length >= 30 AND title_length <= 70 THEN {d(0.5)} "
            f"WHEN title_length < 20 OR title_length > 100 THEN {d(-0.5)} ELSE {d(0)} END")
_M = "(duration_seconds / 60)"
_DUR_F = (f"CASE WHEN category_id IN ('10', '24') THEN CASE WHEN {_M} < 10 THEN {d(0.5)} ELSE {d(0)} END "
          f"WHEN category_id IN ('20', '28') THEN CASE WHEN {_M} >= 10 AND {_M} <= 20 THEN {d(0.5)} ELSE {d(0)} END "
          f"WHEN category_id IN ('22', '23', '27') THEN CASE WHEN {_M} >= 8 AND {_M} <= 18 THEN {d(0.5)} "
          f"ELSE {d(0)} END ELSE {d(0)} END")
_TAG_F = f"CASE WHEN tag_count >= 5 AND tag_count <= 15 THEN {d(0.3)} ELSE {d(0)} END"
_CAT_F = "CASE " + " ".join(f"WHEN category_id = '{k}' THEN {d(v)}" for k, v in S.CATEGORY_FACTORS.items()) \
         + f" ELSE {d(0)} END"
_ADVICE = "CASE " + " ".join(f"WHEN trending_score >= {b} THEN '{lab}'" for b, lab in S.ADVICE_TIERS) \
          + f" ELSE '{S.ADVICE_ELSE}' END"

SQL_HEURISTIC = with_views("requests") + f""", r AS (
  SELECT doc_id, category_id, duration_seconds, len(tags) AS tag_count, length(coalesce(title, '')) AS title_length
  FROM requests),
s AS (SELECT *, greatest({d(0)}, least({d(10)}, {d(5)} + {_TITLE_F} + {_DUR_F} + {_TAG_F} + {_CAT_F}))
          AS trending_score FROM r)
SELECT doc_id, CAST(title_length AS INTEGER) AS title_length, CAST(tag_count AS INTEGER) AS tag_count, trending_score,
       round(trending_score, 1) AS trending_score_rounded,
       CAST(trunc({d(5000)} * (pow({d(2)}, trending_score) / 32)) AS BIGINT) AS views_estimate,
       round(trending_score * 0.8, 1) AS engagement_estimate, {_ADVICE} AS advice_tier
FROM s
"""


@query("heuristic_score", SQL_HEURISTIC)
def heuristic_score(spark, sf):
    """F16 + F18 + F19 + F21 + F22 + F47: rule-based trending score and its derived outputs."""
    r = requests(spark, sf).select("doc_id", "category_id", "duration_seconds",
                                   F.size("tags").alias("tag_count"), TX.char_count("title").alias("title_length"))
    s = r.withColumn("trending_score", SC.heuristic_score("title_length", "duration_seconds", "category_id",
                                                          "tag_count"))
    return s.select(
        "doc_id", "title_length", "tag_count", "trending_score",
        F.bround("trending_score", 1).alias("trending_score_rounded"),
        SC.views_estimate("trending_score").alias("views_estimate"),
        F.bround(SC.engagement_estimate("trending_score"), 1).alias("engagement_estimate"),
        SC.advice_tier("trending_score").alias("advice_tier"))


def _recs_sql(rules) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {Q.q(text)} END" for cond, text in rules)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ' | ')"


_A = S.API_RECOMMENDATIONS
_NL = "length(coalesce(title, ''))"
_MARK = "(instr(coalesce(title, ''), '?') > 0 OR instr(coalesce(title, ''), '!') > 0)"
SQL_RECS_API = with_views("requests") + f"""
SELECT doc_id, {_recs_sql([
    (f"{_NL} < 30", _A["title_short"]),
    (f"{_NL} >= 30 AND {_NL} > 70", _A["title_long"]),
    (f"NOT {_MARK}", _A["punctuation"]),
    ("len(tags) < 5", _A["tags_few"]),
    ("len(tags) >= 5 AND len(tags) > 15", _A["tags_many"]),
    (f"category_id = '10' AND {_M} > 10", _A["music_long"]),
    (f"category_id = '20' AND {_M} < 10", _A["gaming_short"]),
    ("category_id = '24'", _A["entertainment_faces"]),
])} AS recommendations FROM requests
"""


@query("recommendations_api", SQL_RECS_API)
def recommendations_api(spark, sf):
    """endpoint advice per request (list joined with ' | ')."""
    r = requests(spark, sf)
    recs = SC.recommendations_api("title", F.size("tags"), "category_id", "duration_seconds")
    return r.select("doc_id", F.array_join(recs, " | ").alias("recommendations"))


_P = S.PREDICTOR_RECOMMENDATIONS
_DAY = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][publish_weekday + 1]"
_TIMED = "publish_hour IS NOT NULL AND publish_weekday IS NOT NULL"
_H = "publish_hour"
SQL_RECS_CAT = with_views("requests") + f"""
SELECT doc_id, {_recs_sql([
    (f"{_NL} < 30", _P["title_short"]),
    (f"{_NL} >= 30 AND {_NL} > 100", _P["title_long"]),
    (f"NOT {_MARK}", _P["punctuation"]),
    (f"category_id = '10' AND {_M} > 5", _P["music_duration"]),
    (f"category_id IN ('24', '23') AND ({_M} < 8 OR {_M} > 15)", _P["entertainment_duration"]),
    (f"category_id = '20' AND ({_M} < 10 OR {_M} > 25)", _P["gaming_duration"]),
    (f"category_id IN ('27', '28') AND ({_M} < 7 OR {_M} > 20)", _P["education_duration"]),
    ("len(tags) < 5", _P["tags_few"]),
    ("len(tags) >= 5 AND len(tags) > 20", _P["tags_many"]),
    ("length(coalesce(description, '')) < 100", _P["description_short"]),
    (f"{_TIMED} AND category_id = '10' AND {_DAY} NOT IN ('Friday', 'Saturday')", _P["music_day"]),
    (f"{_TIMED} AND category_id = '10' AND NOT ({_H} >= 15 AND {_H} <= 20)", _P["music_hour"]),
    (f"{_TIMED} AND category_id = '20' AND NOT ({_H} >= 14 AND {_H} <= 22)", _P["gaming_hour"]),
    (f"{_TIMED} AND category_id = '24' AND {_DAY} NOT IN ('Thursday', 'Friday', 'Saturday')",
     _P["entertainment_day"]),
    (f"{_TIMED} AND category_id = '25' AND NOT ({_H} >= 7 AND {_H} <= 11) AND NOT ({_H} >= 17 AND {_H} <= 20)",
     _P["news_hour"]),
])} AS recommendations FROM requests
"""


@query("recommendations_category", SQL_RECS_CAT)
def recommendations_category(spark, sf):
    """predictor advice by category and publishing time (list joined with ' | ')."""
    r = requests(spark, sf)
    recs = SC.recommendations_predictor("title", "description", F.size("tags"), "category_id", "duration_seconds",
                                        "publish_hour", "publish_weekday")
    return r.select("doc_id", F.array_join(recs, " | ").alias("recommendations"))


SQL_REQUEST_TEXT = with_views("requests") + f"""
SELECT doc_id, {Q.char_count('title')} AS title_length, {Q.word_count('title')} AS title_word_count,
       {Q.has_pattern('title', TX.DIGIT)} AS title_has_number, {Q.has_literal('title', '?')} AS title_has_question,
       {Q.has_literal('title', '!')} AS title_has_exclamation, {Q.caps_count('title')} AS title_caps_count,
       {Q.char_count('description')} AS description_length, {Q.word_count('description')} AS description_word_count,
       {Q.substring_count('description', 'http')} AS description_url_count,
       CAST(len(tags) AS INTEGER) AS tag_count,
       CAST(coalesce(list_sum(list_transform(tags, lambda x: length(x))), 0) AS DOUBLE)
         / greatest(len(tags), 1) AS tag_avg_length
FROM requests
"""


@query("request_text_features", SQL_REQUEST_TEXT)
def request_text_features(spark, sf):
    """text features of scoring requests."""
    r = requests(spark, sf)
    return r.select("doc_id", *[c.alias(n) for n, c in SC.request_text_features().items()])


_TWO_PI = repr(2 * math.pi)
_SERVING = ([f"CASE WHEN category_id = '{k}' THEN 1 ELSE 0 END AS category_{k}" for k in S.CATEGORY_NAMES]
            + [f"CASE WHEN publish_weekday IS NULL THEN NULL WHEN publish_weekday = {i} THEN 1 ELSE 0 END AS day_{n}"
               for i, n in enumerate(S.DAY_NAMES)]
            + ["CASE WHEN publish_weekday IS NULL THEN NULL WHEN publish_weekday IN (5, 6) THEN 1 ELSE 0 END "
               "AS is_weekend",
               f"round(sin({_TWO_PI} * publish_hour / 24), 9) AS hour_sin",
               f"round(cos({_TWO_PI} * publish_hour / 24), 9) AS hour_cos"]
            + [f"CASE WHEN publish_hour IS NULL THEN NULL WHEN (CASE WHEN publish_hour >= 5 AND publish_hour < 12 "
               f"THEN 'Morning' WHEN publish_hour >= 12 AND publish_hour < 17 THEN 'Afternoon' WHEN publish_hour >= 17 "
               f"AND publish_hour < 21 THEN 'Evening' ELSE 'Night' END) = '{t}' THEN 1 ELSE 0 END AS time_{t}"
               for t in ["Morning", "Afternoon", "Evening", "Night"]]
            + ["coalesce(duration_seconds, 0) AS duration_seconds",
               "round(ln(1 + coalesce(duration_seconds, 0)), 9) AS duration_seconds_log",
               "coalesce(duration_seconds, 0) / 60 AS duration_minutes",
               f"{Q.char_count('title')} AS title_length", f"{Q.word_count('title')} AS title_word_count",
               f"{Q.has_pattern('title', TX.DIGIT)} AS title_has_number",
               f"{Q.has_literal('title', '?')} AS title_has_question",
               f"{Q.has_literal('title', '!')} AS title_has_exclamation",
               f"{Q.caps_count_regex('title')} AS title_caps_count",
               f"{Q.has_pattern('title', f'[^{TX.WORD}{TX.WS}?!.,]')} AS title_has_special",
               f"{Q.has_pattern('title', '[\\[\\](){}]')} AS title_has_brackets",
               "CAST(len(tags) AS INTEGER) AS tag_count",
               f"{Q.char_count('description')} AS description_length",
               f"{Q.word_count('description')} AS description_word_count",
               "round(ln(1 + coalesce(duration_seconds, 0)) / 10, 9) AS duration_seconds_norm",
               f"round(ln(1 + {Q.char_count('title')}) / 10, 9) AS title_length_norm",
               "round(ln(1 + len(tags)) / 10, 9) AS tag_count_norm",
               f"round(ln(1 + {Q.char_count('description')}) / 10, 9) AS description_length_norm"])
SQL_SERVING = with_views("requests") + "SELECT doc_id, " + ",\n       ".join(_SERVING) + " FROM requests"


@query("serving_features", SQL_SERVING)
def serving_features(spark, sf):
    """F54 + F10 + F14: the predictor's feature row for every request (fixed vocabularies)."""
    feats = SC.serving_features()
    out = requests(spark, sf).select("doc_id", *[c.alias(n) for n, c in feats.items()])
    return rounded(out, 9, only=["hour_sin", "hour_cos", "duration_seconds_log", "duration_seconds_norm",
                                 "title_length_norm", "tag_count_norm", "description_length_norm"])
