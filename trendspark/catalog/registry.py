"""Query registry: name -> Spark callable, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB can round to -0.0 where
    Spark's decimal rounding yields 0.0; adding +0.0 turns -0.0 into 0.0 and changes nothing else."""
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(token)])
            i = j + len(token)
            continue
        depth, k = 0, j + len(token) - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounds(sql[j + len(token):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def query(name: str, sql: str | None = None):
    """Register a Spark query; ``sql`` is its DuckDB oracle (None -> rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = positive_zero_rounds(sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 4, only: list[str] | None = None, often_whole: bool = False) -> DataFrame:
    """Round double columns (all, or ``only``) so engine-specific last bits do not matter. ``often_whole``: for tables
    of many flags and counts, as whole numbers (0.0 for -0.0) then skip the costly decimal rounding."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only):
            x = F.col(f.name)
            r = F.round(x, digits)
            cols.append((F.when(F.rint(x) == x, x + 0.0).otherwise(r) if often_whole else r).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
