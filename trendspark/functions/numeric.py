"""Numeric and conditional column expressions.

Every builder returns a ``Column``; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(x, default: float = 0.0) -> Column:
    """coerce to double; unparsable or missing -> ``default``."""
    return F.coalesce(F.expr(f"try_cast({x} AS double)") if isinstance(x, str)
                      else _c(x).try_cast("double"), F.lit(default))


def to_count(x) -> Column:
    """F1 for counts: coerce to bigint, bad/missing -> 0."""
    return F.coalesce(_c(x).try_cast("bigint"), F.lit(0).cast("bigint"))


def log1p(x) -> Column:
    """F2."""
    return F.log1p(_c(x))


def ratio_pct(num, views, cap: float = 100.0) -> Column:
    """num / max(views, 1) * 100, capped at ``cap``."""
    return F.least(F.lit(cap), _c(num) / F.greatest(_c(views), F.lit(1)) * 100)


def engagement_score(likes="likes", comments="comments", views="views",
                     comment_weight: int = 5, cap: float | None = 100.0) -> Column:
    """(likes + w*comments) / max(views,1) * 100, capped (cap=None: no cap)."""
    raw = (_c(likes) + _c(comments) * comment_weight) / F.greatest(_c(views), F.lit(1)) * 100
    return raw if cap is None else F.least(F.lit(cap), raw)


def engagement_columns(views="views", likes="likes", comments="comments") -> dict[str, Column]:
    """F3 + F4 as a column map for ``withColumns``."""
    return {
        "like_view_ratio": ratio_pct(likes, views),
        "comment_view_ratio": ratio_pct(comments, views),
        "engagement_score": engagement_score(likes, comments, views),
    }


def clipped_hours(hours) -> Column:
    """Hours with a one-minute floor."""
    return F.greatest(_c(hours), F.lit(1.0 / 60))


def per_hour(x, hours) -> Column:
    """x per hour since publishing; hours floored at one minute; null hours -> 0."""
    return F.when(_c(hours).isNull(), F.lit(0.0)).otherwise(_c(x) / clipped_hours(hours))


def virality(views, hours) -> Column:
    """vph * log1p(views) / sqrt(max(h, 1)); null when the time is invalid."""
    vph = _c(views) / clipped_hours(hours)
    return F.when(_c(hours).isNotNull(),
                  vph * F.log1p(_c(views)) / F.sqrt(F.greatest(_c(hours), F.lit(1.0))))


def age_adjusted(score, hours) -> Column:
    """score / log1p(max(h, 1/60)); null when the time is invalid."""
    return F.when(_c(hours).isNotNull(), _c(score) / F.log1p(clipped_hours(hours)))


def zscore(x, mean, sd) -> Column:
    """(x - mean) / sd, 0 when sd is 0 or null."""
    return F.when(F.coalesce(_c(sd), F.lit(0.0)) > 0, (_c(x) - _c(mean)) / _c(sd)).otherwise(F.lit(0.0))


def legacy_norm(x) -> Column:
    """serving-side log1p(x)/10 'norm'."""
    return F.log1p(_c(x)) / 10


def duration_minutes(seconds) -> Column:
    """F11."""
    return _c(seconds) / 60


def duration_category(seconds) -> Column:
    """left-closed duration buckets."""
    expr = None
    for bound, label in S.DURATION_CATEGORY_BOUNDS:
        cond = _c(seconds) < bound
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(S.DURATION_CATEGORY_ELSE)


def bin_right_closed(x, edges: list[float], labels: list[str]) -> Column:
    """pandas-cut style right-closed bins (lo, hi]; outside -> null."""
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (_c(x) > lo) & (_c(x) <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def one_hot(x, values: list[str], prefix: str) -> dict[str, Column]:
    """fixed-vocabulary 0/1 columns ``{prefix}_{value}``."""
    return {f"{prefix}_{v}": F.coalesce((_c(x) == F.lit(v)).cast("int"), F.lit(0)) for v in values}


def bankers_round(x, digits: int) -> Column:
    """half-even rounding (Python ``round``)."""
    return F.bround(_c(x), digits)
