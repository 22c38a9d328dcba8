"""Dead letters, CSV by header, bucketed upsert, quantiles of many groups, the bootstrap band."""

import datetime as dt
import glob
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators import bootstrap as BS
from trendspark.operators import quantiles as QU
from trendspark.sources import csv_headers as CH
from trendspark.sources import upsert as UP
from trendspark.streaming import deadletter as DL


def folder():
    return tempfile.mkdtemp(prefix="trendspark-test-")


RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("views", T.LongType())])


def lines(path, name, rows):
    with open(f"{path}/{name}", "w") as f:
        f.write("".join(r + "\n" for r in rows))


def test_every_line_is_in_exactly_one_table(spark):
    source, out = folder(), folder()
    good = [json.dumps({"id": i, "region": r, "views": 10 * i}) for i, r in enumerate(["ASIA", "EUROPE", "ASIA", "EUROPE"])]
    bad = ['{"id": 7, "reg', json.dumps({"region": "ASIA", "views": 1}), json.dumps({"id": 9, "region": "MARS"}), json.dumps({"id": 9, "region": None}), "", '{"id": "many", "region": "ASIA"}']
    lines(source, "a.json", [*good[:2], *bad[:3]])
    lines(source, "b.json", [*good[2:], *bad[3:]])
    fails = {"on": True}

    def handle(df):
        if fails["on"] and df.where("region = 'EUROPE'").count():
            raise RuntimeError("EUROPE cannot be reached")
        return df.withColumn("seen", F.lit(1))

    letters = DL.DeadLetters(out, RECORD, ("id",), ("ASIA", "EUROPE"), handle=handle)
    letters.drain(DL.text_stream(spark, source), folder())
    assert sorted(r.id for r in letters.good(spark).collect()) == [0, 2] and {r.seen for r in letters.good(spark).collect()} == {1}
    side = letters.bad(spark).collect()
    reasons = {r.value: r.reason for r in side}
    assert len(side) == 2 + len(bad) and set(reasons) == {good[1], good[3], *bad}
    assert reasons[bad[0]] == "not JSON" and reasons[bad[1]] == "missing id" and reasons[bad[2]] == reasons[bad[3]] == "unknown region"
    assert "EUROPE cannot be reached" in reasons[good[1]] and all(os.path.basename(r.source_file) in ("a.json", "b.json") for r in side)

    fails["on"] = False
    letters.replay(spark, "1", lambda value, reason: F.when(reason == "unknown region", F.regexp_replace(value, '"MARS"', '"ASIA"')).otherwise(value))
    assert sorted(r.id for r in letters.good(spark).collect()) == [0, 1, 2, 3, 9]
    left = letters.bad(spark).collect()
    assert {r.value for r in left} == {bad[0], bad[1], bad[3], bad[4], bad[5]} and {r.batch for r in left} == {"replay-1"}
    letters.replay(spark, "1")  # complete: not run again
    assert letters.good(spark).count() == 5 and letters.bad(spark).count() == 5
    letters.replay(spark, "2")  # nothing repaired: the same rows wait
    assert letters.good(spark).count() == 5 and letters.bad(spark).count() == 5


def test_a_repeated_batch_replaces_itself(spark):
    letters = DL.DeadLetters(folder(), RECORD, ("id",), ("ASIA",))
    raw = spark.createDataFrame([('{"id": 1, "region": "ASIA"}', "f"), ("x", "f")], "value string, source_file string")
    for _ in range(2):
        letters.process(raw, "0")
    letters.process(raw.limit(0), "1")
    assert letters.good(spark).count() == 1 and letters.bad(spark).count() == 1


def test_csv_files_with_other_headers(spark):
    path = folder()
    lines(path, "a.csv", ["id,name,views", "1,one,10", '2,"two, and\nmore",NaN', "3,three,abc"])
    lines(path, "b.csv", ["views,id", "40,4", "50,5,extra", "60"])
    lines(path, "c.csv", ["﻿ID,other", "6,x"])
    lines(path, "d.csv", ["id,id", "7,8"])
    lines(path, "e.csv", [])
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("views", T.DoubleType())])
    good, bad = CH.read_csv_by_header(spark, path, kind)
    assert good.schema.simpleString() == kind.simpleString()
    rows = {r.id: (r.name, r.views) for r in good.collect()}
    assert rows == {1: ("one", 10.0), 2: ("two, and\nmore", None), 3: ("three", None), 4: (None, 40.0), 6: (None, None)}
    side = sorted((os.path.basename(r.source_file), r.value) for r in bad.collect())
    assert ("b.csv", "50,5,extra") in side and ("b.csv", "60") in side and ("d.csv", "7,8") in side
    assert len(side) == 4 and all(r.reason for r in bad.collect())


def test_untouched_buckets_keep_their_files(spark):
    path, key = folder() + "/t", ["id"]
    rows = spark.createDataFrame([(i, f"v{i}", 1) for i in range(200)], "id long, name string, at int")
    assert UP.upsert_into(rows, path, key, "at", "a", buckets=16)
    before = set(glob.glob(f"{path}/rows/*/part-*"))
    assert len({os.path.dirname(f) for f in before}) == 16
    change = spark.createDataFrame([(5, "new", 2), (7, "old", 0), (1000, "more", 1)], "id long, name string, at int")
    assert UP.upsert_into(change, path, key, "at", "b", buckets=16)
    after = set(glob.glob(f"{path}/rows/*/part-*"))
    touched = {os.path.dirname(f) for f in before - after}
    assert 1 <= len(touched) <= 3 and len(before & after) >= 13
    got = {r.id: (r.name, r["at"]) for r in UP.read_upserted(spark, path).collect()}
    assert len(got) == 201 and got[5] == ("new", 2) and got[7] == ("v7", 1) and got[1000] == ("more", 1)
    assert not UP.upsert_into(change, path, key, "at", "b", buckets=16) and set(glob.glob(f"{path}/rows/*/part-*")) == after
    assert UP.upsert_into(change.limit(0), path, key, "at", "c", buckets=16) and UP.read_upserted(spark, path).count() == 201


def test_quantiles_of_many_groups_and_hot_ones(spark):
    draw = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(draw.integers(0, 60, 600), draw.normal(size=600), strict=True)]
    rows += [(100, float(v)) for v in draw.normal(size=900) * 1e6] + [(101, 5.0)] * 400 + [(102, float(v)) for v in draw.integers(0, 4, 500)]
    rows += [(103, None), (None, 1.0), (104, float("nan")), (104, 2.0), (105, float("inf")), (106, 1e-300), (106, 1e300)]
    df = spark.createDataFrame(rows, "g long, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in QU.quantiles_of_groups(df, "g", "x", probs, small=100, buckets=8).collect()}
    values = {}
    for g, x in rows:
        if g is not None and x is not None and np.isfinite(x):
            values.setdefault(g, []).append(x)
    assert set(got) == set(values)
    for g, own in values.items():
        assert got[g] == pytest.approx(np.quantile(own, probs).tolist(), rel=1e-12)
    assert QU.quantiles_of_groups(df.limit(0), "g", "x", probs).count() == 0


def test_bootstrap_band(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(10, 2, 2000)
    df = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(x)] + [(5000, 0, None), (5001, 7, 3.0)], "id long, g int, x double")
    got = {r.g: r for r in BS.bootstrap_band(df, "g", "x", "id", replicates=200).collect()}
    for g in (0, 1):
        own = x[np.arange(2000) % 2 == g]
        half = 1.96 * own.std() / np.sqrt(len(own))
        assert got[g].n == len(own) and got[g].mean == pytest.approx(own.mean())
        assert got[g].ci_lo == pytest.approx(own.mean() - half, abs=0.25 * half) and got[g].ci_hi == pytest.approx(own.mean() + half, abs=0.25 * half)
    assert got[7].ci_lo == got[7].ci_hi == 3.0
    again = BS.bootstrap_band(df.repartition(7), "g", "x", "id", replicates=200).collect()
    assert {r.g: r.ci_lo for r in again} == pytest.approx({g: r.ci_lo for g, r in got.items()}) and {r.g: r.ci_hi for r in again} == pytest.approx({g: r.ci_hi for g, r in got.items()})


def test_poisson_weights_have_mean_and_variance_one(spark):
    df = spark.range(20_000).select(BS._weight(F.substring(F.md5(F.col("id").cast("string")), 1, 8)).alias("w"))
    r = df.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert r.m == pytest.approx(1, abs=0.03) and r.v == pytest.approx(1, abs=0.05)
