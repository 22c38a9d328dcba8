"""Scoring expressions (F16-F21, F51-F54) - rule-based scores and advice as columns.

Everything is a column expression, so scoring a table of requests is one
projection; no per-row Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.functions import temporal as TM
from trendspark.functions import text as TX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _in(x, values) -> Column:
    return _c(x).isin(*values)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def duration_factor(category_id, duration_seconds) -> Column:
    """Per-category duration preference (+0.5 inside the preferred range)."""
    m = _c(duration_seconds) / 60
    cat = _c(category_id)
    return (F.when(_in(cat, ["10", "24"]), F.when(m < 10, 0.5).otherwise(0.0))
            .when(_in(cat, ["20", "28"]), F.when((m >= 10) & (m <= 20), 0.5).otherwise(0.0))
            .when(_in(cat, ["22", "23", "27"]), F.when((m >= 8) & (m <= 18), 0.5).otherwise(0.0))
            .otherwise(0.0))


def category_factor(category_id) -> Column:
    expr = None
    for k, v in S.CATEGORY_FACTORS.items():
        cond = _c(category_id) == k
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(0.0))


def heuristic_score(title_length, duration_seconds, category_id, tag_count) -> Column:
    """F16: 5 + title + duration-by-category + tags + category factor, clamped to 0..10."""
    tags = F.when((_c(tag_count) >= 5) & (_c(tag_count) <= 15), F.lit(0.3)).otherwise(F.lit(0.0))
    raw = (F.lit(5.0) + TX.title_length_advice(title_length) + duration_factor(category_id, duration_seconds)
           + tags + category_factor(category_id))
    return clamp(raw, 0, 10)


def blend_probability(score, probability) -> Column:
    """0.3 * heuristic + 0.7 * 10 * p when a probability exists; clamped 0..10."""
    p = _c(probability)
    return clamp(F.when(p.isNotNull(), _c(score) * 0.3 + p * 10 * 0.7).otherwise(_c(score)), 0, 10)


def views_estimate(score) -> Column:
    """F18 (endpoint): int(5000 * 2^s / 32), truncated."""
    return (F.lit(5000.0) * (F.pow(F.lit(2.0), _c(score)) / 32)).cast("bigint")


def views_from_rate(views_per_hour) -> Column:
    """F18 (model form): predicted views per hour over 48 hours, truncated."""
    return (_c(views_per_hour) * 48).cast("bigint")


def views_estimate_100(score100) -> Column:
    """F18 (predictor form): int(5000 * 2^(s/20)) for a 0..100 score."""
    return (F.lit(5000.0) * F.pow(F.lit(2.0), _c(score100) / 20)).cast("bigint")


def engagement_estimate(score, predicted=None) -> Column:
    """0.8 * score, or the model's value clamped to 0..10 when present."""
    base = _c(score) * 0.8
    if predicted is None:
        return base
    return F.when(_c(predicted).isNotNull(), clamp(predicted, 0, 10)).otherwise(base)


def combined_score(engagement, viral_probability) -> Column:
    """(eng * 0.6 + 10 * p * 0.4) * 10, clamped to 0..100."""
    return clamp((_c(engagement) * 0.6 + _c(viral_probability) * 10 * 0.4) * 10, 0, 100)


def advice_tier(score) -> Column:
    """F21."""
    expr = None
    for bound, label in S.ADVICE_TIERS:
        cond = _c(score) >= bound
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(S.ADVICE_ELSE)


def _recs(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda x: x.isNotNull())


def recommendations_api(title, tag_count, category_id, duration_seconds) -> Column:
    """endpoint advice list, in rule order."""
    R = S.API_RECOMMENDATIONS
    n = F.length(TX.text_or_empty(title))
    has_mark = (F.instr(TX.text_or_empty(title), "?") > 0) | (F.instr(TX.text_or_empty(title), "!") > 0)
    m = _c(duration_seconds) / 60
    cat = _c(category_id)
    tc = _c(tag_count)
    return _recs([
        (n < 30, R["title_short"]),
        ((n >= 30) & (n > 70), R["title_long"]),
        (~has_mark, R["punctuation"]),
        (tc < 5, R["tags_few"]),
        ((tc >= 5) & (tc > 15), R["tags_many"]),
        ((cat == "10") & (m > 10), R["music_long"]),
        ((cat == "20") & (m < 10), R["gaming_short"]),
        (cat == "24", R["entertainment_faces"]),
    ])


def recommendations_predictor(title, description, tag_count, category_id, duration_seconds,
                              publish_hour, publish_weekday) -> Column:
    """predictor advice list (title, duration by category, tags, description, timing)."""
    R = S.PREDICTOR_RECOMMENDATIONS
    t = TX.text_or_empty(title)
    n = F.length(t)
    has_mark = (F.instr(t, "?") > 0) | (F.instr(t, "!") > 0)
    m = _c(duration_seconds) / 60
    cat = _c(category_id)
    tc = F.coalesce(_c(tag_count), F.lit(0))
    h, wd = _c(publish_hour), _c(publish_weekday)
    timed = h.isNotNull() & wd.isNotNull()
    day = TM.day_name(wd)
    return _recs([
        (n < 30, R["title_short"]),
        ((n >= 30) & (n > 100), R["title_long"]),
        (~has_mark, R["punctuation"]),
        ((cat == "10") & (m > 5), R["music_duration"]),
        (_in(cat, ["24", "23"]) & ((m < 8) | (m > 15)), R["entertainment_duration"]),
        ((cat == "20") & ((m < 10) | (m > 25)), R["gaming_duration"]),
        (_in(cat, ["27", "28"]) & ((m < 7) | (m > 20)), R["education_duration"]),
        (tc < 5, R["tags_few"]),
        ((tc >= 5) & (tc > 20), R["tags_many"]),
        (F.length(TX.text_or_empty(description)) < 100, R["description_short"]),
        (timed & (cat == "10") & ~day.isin("Friday", "Saturday"), R["music_day"]),
        (timed & (cat == "10") & ~((h >= 15) & (h <= 20)), R["music_hour"]),
        (timed & (cat == "20") & ~((h >= 14) & (h <= 22)), R["gaming_hour"]),
        (timed & (cat == "24") & ~day.isin("Thursday", "Friday", "Saturday"), R["entertainment_day"]),
        (timed & (cat == "25") & ~((h >= 7) & (h <= 11)) & ~((h >= 17) & (h <= 20)), R["news_hour"]),
    ])


def request_text_features(title="title", description="description", tags="tags") -> dict[str, Column]:
    """text features of a scoring request (tags is an array column)."""
    tg = F.coalesce(_c(tags), F.array().cast("array<string>"))
    n_tags = F.size(tg)
    total = F.aggregate(F.transform(tg, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    return {
        "title_length": TX.char_count(title),
        "title_word_count": TX.word_count(title),
        "title_has_number": TX.has_pattern(title, TX.DIGIT),
        "title_has_question": TX.has_literal(title, "?"),
        "title_has_exclamation": TX.has_literal(title, "!"),
        "title_caps_count": TX.caps_count(title),
        "description_length": TX.char_count(description),
        "description_word_count": TX.word_count(description),
        "description_url_count": TX.substring_count(description, "http"),
        "tag_count": n_tags,
        "tag_avg_length": total / F.greatest(n_tags, F.lit(1)),
    }


def serving_features(category_id="category_id", publish_hour="publish_hour", publish_weekday="publish_weekday",
                     duration_seconds="duration_seconds", title="title", description="description",
                     tags="tags") -> dict[str, Column]:
    """F54 (+F10): the predictor's feature row as columns (one-hot on the fixed vocabularies)."""
    out: dict[str, Column] = {}
    for k in S.CATEGORY_NAMES:
        out[f"category_{k}"] = F.coalesce((_c(category_id) == k).cast("int"), F.lit(0))
    wd, h = _c(publish_weekday), _c(publish_hour)
    for i, d in enumerate(S.DAY_NAMES):
        out[f"day_{d}"] = F.when(wd.isNull(), None).otherwise((wd == i).cast("int"))
    out["is_weekend"] = F.when(wd.isNull(), None).otherwise(wd.isin(5, 6).cast("int"))
    out["hour_sin"] = F.sin(F.lit(2 * math.pi) * h / 24)
    out["hour_cos"] = F.cos(F.lit(2 * math.pi) * h / 24)
    tod = TM.time_of_day(h, evening_end=21, capitalized=True)
    for name in ["Morning", "Afternoon", "Evening", "Night"]:
        out[f"time_{name}"] = F.when(h.isNull(), None).otherwise((tod == name).cast("int"))
    d = F.coalesce(_c(duration_seconds), F.lit(0))
    out["duration_seconds"] = d
    out["duration_seconds_log"] = F.log1p(d)
    out["duration_minutes"] = d / 60
    out["title_length"] = TX.char_count(title)
    out["title_word_count"] = TX.word_count(title)
    out["title_has_number"] = TX.has_pattern(title, TX.DIGIT)
    out["title_has_question"] = TX.has_literal(title, "?")
    out["title_has_exclamation"] = TX.has_literal(title, "!")
    out["title_caps_count"] = TX.caps_count_regex(title)
    out["title_has_special"] = TX.has_special(title)
    out["title_has_brackets"] = TX.has_brackets(title)
    out["tag_count"] = F.size(F.coalesce(_c(tags), F.array().cast("array<string>")))
    out["description_length"] = TX.char_count(description)
    out["description_word_count"] = TX.word_count(description)
    for c in S.LEGACY_NORM_COLUMNS:
        out[f"{c}_norm"] = F.log1p(out[c]) / 10
    return out
