"""Date and time column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_time(x, fmt: str | None = None) -> Column:
    """Text -> timestamp; unparsable -> null (never raises under ANSI)."""
    if fmt is None:
        return F.try_to_timestamp(_c(x))
    return F.try_to_timestamp(_c(x), F.lit(fmt))


def time_parts(ts, prefix: str = "publish") -> dict[str, Column]:
    """hour, day of month, month, year, weekday (Mon=0), weekend flag, quarter."""
    t = _c(ts)
    wd = F.weekday(t)
    return {
        f"{prefix}_hour": F.hour(t),
        f"{prefix}_dom": F.dayofmonth(t),
        f"{prefix}_month": F.month(t),
        f"{prefix}_year": F.year(t),
        f"{prefix}_weekday": wd,
        f"{prefix}_weekend": (wd >= 5).cast("int"),
        f"{prefix}_quarter": F.quarter(t),
    }


def time_of_day(hour, evening_end: int = 22, capitalized: bool = False) -> Column:
    """morning [5,12), afternoon [12,17), evening [17,evening_end), else night."""
    h = _c(hour)
    names = ["morning", "afternoon", "evening", "night"]
    if capitalized:
        names = [n.capitalize() for n in names]
    return (F.when(h.isNull(), F.lit(None).cast("string"))
            .when((h >= 5) & (h < 12), names[0])
            .when((h >= 12) & (h < 17), names[1])
            .when((h >= 17) & (h < evening_end), names[2])
            .otherwise(names[3]))


def cycle(x, period: int, fn: str) -> Column:
    """sin/cos(2*pi*x/period)."""
    arg = F.lit(2 * math.pi) * _c(x) / F.lit(period)
    return F.sin(arg) if fn == "sin" else F.cos(arg)


def cyclic_columns(hour="publish_hour", dom="publish_dom", month="publish_month",
                   weekday="publish_weekday") -> dict[str, Column]:
    """F27 for the four calendar parts."""
    out = {}
    for name, col, period in (("hour", hour, 24), ("day", dom, 31), ("month", month, 12),
                              ("dayofweek", weekday, 7)):
        out[f"{name}_sin"] = cycle(col, period, "sin")
        out[f"{name}_cos"] = cycle(col, period, "cos")
    return out


def hours_between(start, end) -> Column:
    """(end - start) in fractional hours; null if either is null."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return micros.cast("double") / 3.6e9


def delay_category(hours) -> Column:
    """same_day <24h, next_day <48h, same_week <168h, later."""
    h = _c(hours)
    expr = F.when(h.isNull(), F.lit(None).cast("string"))
    for bound, label in S.DELAY_BOUNDS:
        expr = expr.when(h < bound, label)
    return expr.otherwise(S.DELAY_ELSE)


def iso_duration_seconds(x) -> Column:
    """ISO-8601 duration text -> seconds from its H, M, S parts (other parts ignored).

    Non-text / null -> 0, like the original parser. The first match of each part wins.
    """
    s = _c(x)

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(s, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0))

    secs = part("H") * 3600 + part("M") * 60 + part("S")
    return F.when(s.isNull(), F.lit(0).cast("bigint")).otherwise(secs.cast("bigint"))


def day_name(weekday) -> Column:
    """0..6 -> Monday..Sunday; else null."""
    arr = F.array(*[F.lit(d) for d in S.DAY_NAMES])
    w = _c(weekday)
    return F.when((w >= 0) & (w < 7), F.element_at(arr, (w + 1).cast("int")))
