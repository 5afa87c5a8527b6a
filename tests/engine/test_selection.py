"""Exact quantiles by counting digits, against numpy and Spark's own percentile."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cross, selection


def test_digits_never_fall_as_values_rise(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1 / 3, 2.0**52, 0.9999999999999999, 1.0000000000000002]
    xs += [struct.unpack(">d", struct.pack(">Q", r.getrandbits(64)))[0] for _ in range(3000)]
    xs += [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1000, 1024, 7)] + [100 + i * 1e-9 for i in range(1000)]
    xs = sorted(x for x in xs if x == x)
    d = selection.coarse(F.col("x"))
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", d.alias("d"), selection.fine(F.col("x"), d).alias("e")).collect()
    digits = [(q["d"], q["e"]) for q in sorted(out, key=lambda q: q["x"])]
    assert digits == sorted(digits) and len(set(digits)) > 6000 and {q["d"] for q in out if q["x"] == 0} == {0}
    last = spark.createDataFrame([(float("nan"),)], "x double").select(d.alias("d")).first()
    assert last["d"] > digits[-1][0]


QS = [0.0, 0.025, 0.1, 0.3, 0.5, 0.75, 0.975, 1.0]


def groups():
    r = random.Random(3)
    yield "one", [7.5]
    yield "two", [1.0, 2.0]
    yield "ties", [1.0] * 50 + [2.0] * 50 + [-3.0]
    yield "zeros", [0.0, -0.0, 0.0, 1e-300]
    yield "close", [100 + i * 1e-12 for i in range(500)]  # the first 32 bits are the same
    yield "wide", [r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300) for _ in range(800)]
    yield "normal", [r.gauss(0, 1) for _ in range(3000)]
    yield "inf", [float("-inf"), 1.0, float("inf")]


def test_quantiles_equal_numpy_s(spark):
    data = dict(groups())
    rows = [(k, x) for k, xs in data.items() for x in xs] + [("two", None), ("none", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    out = {r["g"]: r["q"] for r in selection.group_quantiles(df, "x", QS, ["g"], "q").collect()}
    assert set(out) == set(data)
    for g, xs in data.items():
        s = sorted(xs)
        for q, got in zip(QS, out[g], strict=True):
            at = (len(s) - 1) * q
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            if np.isfinite(high - low) or low == high:  # between infinities there is no value
                assert got == (low if low == high else low + (high - low) * (at - np.floor(at)))
    assert [out["inf"][QS.index(q)] for q in (0.0, 0.5, 1.0)] == [float("-inf"), 1.0, float("inf")]


def test_struct_keys_many_columns_and_bounds(spark):
    df = spark.createDataFrame([("a", 1, 3.0, None), ("a", 1, 5.0, None), ("b", 2, 1.0, 8.0)], "g string, h int, x double, y double")
    out = {r["k"]["g"]: r for r in selection.quantile_columns(df.withColumn("k", F.struct("g", "h")), {"mx": ("x", 0.5), "hi": ("x", 1.0), "my": ("y", 0.5), "gap": (F.abs(F.col("x") - 4), 0.5)}, ["k"]).collect()}
    assert (out["a"]["mx"], out["a"]["hi"], out["a"]["my"], out["a"]["gap"]) == (4.0, 5.0, None, 1.0) and out["b"]["my"] == 8.0
    with pytest.raises(ValueError):
        selection.group_quantiles(df, "x", [1.5], ["g"])
    assert selection.group_quantiles(df.filter("false"), "x", [0.5], ["g"]).count() == 0


def test_no_group_is_one_task_s_state(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 as string) as date", "cast(id as string) as code", "cast(id as double) as fac")
    for out in (cross.clip_mad(df), cross.clip_percentile(df), cross.quantile_group(df), cross.distance(df, 0.5)):
        plan = out._jdf.queryExecution().toString()
        assert "percentile(" not in plan and "Python" not in plan


def test_a_date_without_values_keeps_its_rows(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 9.0), ("e", "a", None)], "date string, code string, fac double")
    for out in (cross.clip_mad(df), cross.clip_mad(df, how="trend"), cross.clip_percentile(df, 0.0, 1.0), cross.distance(df, 0.5)):
        assert sorted(out.select("date", "code").collect()) == sorted(df.select("date", "code").collect())
        assert out.filter("date = 'e'").first()["fac"] is None
    assert cross.quantile_group(df, 2).filter("date = 'e'").first()["label"] is None
