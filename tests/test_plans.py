"""Plan shape: no Python in the hot path, top-k without a full sort, broadcast only for bounded sides,
filters pushed into the scan."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

SQL_KEYS = [n for n in E.oracle_sql() if not n.startswith(("stream_", "ml_"))
            and n not in {"insight_report", "feature_matrix", "quartile_targets"}]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_KEYS)
def test_no_python_udfs(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_topk_uses_take_ordered(spark):
    p = plan(E.queries()["trending_topn"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_dimension_join_is_broadcast(spark):
    p = plan(E.queries()["category_lookup_left"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_region_filter_pushed_to_scan(spark):
    df = E.queries()["category_stats"](spark, SF_SMALL)
    p = plan(df)
    scan = [ln for ln in p.split("\n") if "FileScan" in ln and "region.parquet" in ln][0]
    assert "EqualTo(r_name,ASIA)" in scan.split("PushedFilters:")[1]


def test_scan_prunes_columns(spark):
    p = plan(E.queries()["category_counts"](spark, SF_SMALL))
    # only the join key is read from orders, and the unused lineitem join is removed
    assert "ReadSchema: struct<o_custkey:bigint>" in p and "lineitem" not in p
