"""Scans of composed maps against loops over rows, over several blocks of dates."""

import datetime as dt
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from gridloom.operators import scans, series, timing

DAY = dt.date(1999, 12, 1)


def frame(spark, codes, days, seed):
    r = random.Random(seed)
    rows = []
    for c in codes:
        at = DAY
        for _ in range(days):
            at += dt.timedelta(r.choice((1, 1, 1, 2, 3, 40)))
            rows.append((at, c, r.choice((None, r.uniform(-0.9, 1.0), 0.0)), r.choice((None, r.uniform(-5, 5))), r.choice((None, 2.0))))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "date date, code string, a double, b double, f double").repartition(5)


def test_affine_steps_equal_a_loop(spark):
    df = frame(spark, ["x", "y"], 400, 1)
    out = scans.affine_scan(df, {"v": (F.col("a"), F.col("b"), F.col("f")), "sum": (F.lit(1.0), F.coalesce("b", F.lit(0.0)), F.lit(0.0))})
    assert set(out.columns) == {*df.columns, "v", "sum"}
    rows = sorted(out.collect(), key=lambda r: (r["code"], r["date"]))
    assert len(rows) == 800 and len({(r["date"] - dt.date(1970, 1, 1)).days // scans.BLOCK_DAYS for r in rows}) > 3
    for code in "xy":
        own = [r for r in rows if r["code"] == code]
        seed = next(i for i, r in enumerate(own) if r["f"] is not None)
        x, total = own[seed]["f"], 0.0
        for i, r in enumerate(own):
            if r["a"] is not None and r["b"] is not None:
                x = r["a"] * x + r["b"]
            v = x if i >= seed else None
            total += r["b"] or 0.0
            assert (r["v"] is None) == (v is None) and (v is None or r["v"] == pytest.approx(v, rel=1e-9, abs=1e-9))
            assert r["sum"] == pytest.approx(total, abs=1e-9)


def test_exponential_means_equal_a_loop_and_skip_nulls(spark):
    df = frame(spark, ["x"], 300, 2)
    rows = scans.affine_scan(df, {"m": scans.ema_steps(F.col("b"), 12)}).orderBy("date").collect()
    m = None
    for r in rows:
        if r["b"] is not None:
            m = r["b"] if m is None else m + 2 / 13 * (r["b"] - m)
        assert (r["m"] is None) == (m is None) and (m is None or r["m"] == pytest.approx(m, rel=1e-12))


def machine(state, lo, so, lc, sc):
    if state == 0:
        return 1 if lo else -1 if so else 0
    if state == 1:
        return (-1 if so else 0) if lc else 1
    return (1 if lo else 0) if sc else -1


def test_every_combination_of_events_from_every_state(spark):
    # A code for each state and combination: events that lead to the state, then the combination, then nothing.
    lead = {0: [], 1: [(True, False, False, False)], -1: [(False, True, False, False)]}
    rows, want = [], {}
    for state, events in product((0, 1, -1), product((False, True), repeat=4)):
        code = f"{state}{''.join('01'[e] for e in events)}"
        steps = [*lead[state], events, (False,) * 4]
        rows += [(DAY + dt.timedelta(600 * i), code, *e) for i, e in enumerate(steps)]  # blocks lie between
        want[code] = machine(state, *events)
    x = spark.createDataFrame(rows, "date date, code string, lo boolean, so boolean, lc boolean, sc boolean")
    out = timing.long_short_signal(x).orderBy("code", "date").collect()
    for code, signal in want.items():
        got = [r["signal"] for r in out if r["code"] == code]
        assert got[-2] == signal and got[-1] == signal


def test_long_runs_of_events_equal_a_loop(spark):
    r = random.Random(9)
    flag = lambda: r.choice((True, False, False, None))
    rows = [(DAY + dt.timedelta(3 * i), c, flag(), flag(), flag(), flag()) for c in "pq" for i in range(700)]
    x = spark.createDataFrame(rows, "date date, code string, lo boolean, so boolean, lc boolean, sc boolean").repartition(4)
    out = {(q["code"], q["date"]): q["signal"] for q in timing.long_short_signal(x).collect()}
    assert len(out) == 1400
    for c in "pq":
        state = 0
        for row in rows:
            if row[1] == c:
                state = machine(state, *row[2:])
                assert out[c, row[0]] == state


def test_a_key_is_spread_over_its_blocks_and_no_python_runs(spark):
    df = frame(spark, ["x"], 10, 3).withColumnRenamed("a", "close").withColumn("vol", F.lit(1.0))
    for out in (scans.affine_scan(df, {"m": scans.ema_steps(F.col("b"), 3)}), series.trend_strength(df), series.resonance(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(code" in plan and "_block" in plan and "Python" not in plan and "Pandas" not in plan


def test_no_rows(spark):
    none = frame(spark, ["x"], 3, 4).filter("false")
    assert scans.affine_scan(none, {"m": scans.ema_steps(F.col("b"), 3)}).count() == 0
