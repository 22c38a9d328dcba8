"""Every registered query with an oracle equals its DuckDB SQL (sf0.001; the driver runs sf0.01)."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from trendspark.sources.tables import TABLES, table_path

from conftest import SF_SMALL

SLOW = {"insight_report"}
NAMES = [n for n in E.oracle_sql() if n not in SLOW]


def _norm(v):
    if v is pd.NA:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _rows(sp) == _rows(dd)


def test_every_query_has_callable_and_entry(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.count() >= 0 and "avg_engagement" in df.columns
