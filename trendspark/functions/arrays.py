"""Array / map / JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.text import WS

_WS_TRIM = f"^[{WS}]+|[{WS}]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(x), _WS_TRIM, "")


def parse_tags(x) -> Column:
    """null/blank -> []; '[...]' parsed as a JSON list when valid; else comma split + strip."""
    s = strip_ws(F.coalesce(_c(x), F.lit("")))
    as_json = F.from_json(s, "array<string>")
    is_list = s.startswith("[") & s.endswith("]") & as_json.isNotNull()
    comma = F.transform(F.split(s, ","), lambda t: strip_ws(t))
    return (F.when(s == "", F.array().cast("array<string>"))
            .when(is_list, as_json)
            .otherwise(comma))


def split_pipe(x) -> Column:
    """'|'-separated tags, empty parts dropped."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\|"), lambda t: t != "")


def mean_length(arr) -> Column:
    """mean element length; 0 for an empty list."""
    a = _c(arr)
    total = F.aggregate(F.transform(a, lambda t: F.length(t)), F.lit(0), lambda acc, n: acc + n)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(F.lit(0.0))


def fill_features(df: DataFrame, names: list[str], default: float = 0.0) -> DataFrame:
    """select ``names`` in order; absent or null -> default (as double)."""
    present = set(df.columns)
    return df.select(*[
        (F.coalesce(F.col(n).cast("double"), F.lit(default)) if n in present else F.lit(default)).alias(n)
        for n in names])


def explode_map(df: DataFrame, col: str, key: str = "feature", value: str = "importance",
                keep: list[str] = ()) -> DataFrame:
    """map column -> (key, value) rows."""
    return df.select(*keep, F.explode(F.col(col)).alias(key, value))
