"""Small fixtures with known answers: nulls, ties, single rows, zero denominators, holes, empty tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns
from gridloom.operators import cross, evaluation, intraday, options, returns, series, timing
from gridloom.sources import readers

DAY = dt.date(2024, 1, 1)


def panel(spark, cells):
    """cells: {code: [values by day]}; None is a null, '' a missing row."""
    rows = [(DAY + dt.timedelta(i), c, v) for c, values in cells.items() for i, v in enumerate(values) if v != ""]
    return spark.createDataFrame(rows, "date date, code string, fac double")


def values(df, col="fac"):
    return {(r["date"].toordinal() - DAY.toordinal(), r["code"]): r[col] for r in df.collect()}


def test_zscore_of_equal_single_and_null_values(spark):
    out = values(cross.zscore(panel(spark, {"a": [1.0, 2.0, None], "b": [1.0, "", 1.0], "c": [1.0, "", 3.0]})))
    assert out[0, "a"] is None and out[1, "a"] is None and out[2, "a"] is None
    assert out[2, "b"] == pytest.approx(-(0.5**0.5)) and out[2, "c"] == pytest.approx(0.5**0.5)


def test_trend_clip_keeps_order_and_a_zero_deviation_alone(spark):
    x = panel(spark, {c: [v, 1.0] for c, v in zip("abcdefghi", [-50.0, -40.0, 1.0, 2.0, 3.0, 4.0, 5.0, 40.0, 50.0], strict=True)})
    out = values(cross.clip_mad(x, 1.0, "trend"))
    assert [out[0, c] for c in "abcdefghi"] == [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 5.5, 6.0]
    assert all(out[1, c] == 1.0 for c in "abcdefghi")


def test_clip_refuses_what_it_does_not_know(spark):
    x = panel(spark, {"a": [1.0]})
    for method, parameter in (("mad", 5), ("percentile", 0.1), ("other", None)):
        with pytest.raises(ValueError):
            cross.clip(x, method, parameter)


def test_quantile_groups_of_ties_and_nulls(spark):
    out = values(cross.quantile_group(panel(spark, {c: [v] for c, v in zip("abcde", [1.0, 1.0, 1.0, 2.0, None], strict=True)}), 2), "label")
    want = pd.qcut(pd.Series([1.0, 1.0, 1.0, 2.0]), 2, labels=False, duplicates="drop").tolist()
    assert [out[0, c] for c in "abcd"] == want and out[0, "e"] is None


def test_equal_groups_put_the_rest_last_and_few_codes_in_the_last(spark):
    x = panel(spark, {c: [float(i), float(i) if i < 2 else ""] for i, c in enumerate("abcdefg")})
    out = values(evaluation.equal_groups(x, 3), "grp")
    assert [out[0, c] for c in "abcdefg"] == [1, 1, 2, 2, 3, 3, 3]
    assert {out[1, "a"], out[1, "b"]} == {1, 2} or {out[1, "a"], out[1, "b"]} == {3}


def test_grid_shift_sees_holes(spark):
    x = series.on_grid(panel(spark, {"a": [1.0, "", 3.0], "b": [1.0, 2.0, 3.0]}))
    out = values(x.withColumn("fac", series.shifted("fac")))
    assert out[2, "a"] is None and out[2, "b"] == 2.0 and out[0, "a"] is None
    assert series.densify(panel(spark, {"a": [1.0, ""], "b": [1.0, 2.0]})).count() == 4


def test_rolling_counts_values_not_rows(spark):
    x = series.on_grid(panel(spark, {"a": [1.0, None, 3.0, 5.0]}))
    out = values(x.withColumn("fac", series.rolling("fac", 3, min_periods=2)))
    assert [out[i, "a"] for i in range(4)] == [None, None, 2.0, 4.0]


def test_orthogonal_factors_have_the_identity_as_covariance(spark):
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(40, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.7], [0, 0, 1]])
    df = spark.createDataFrame([(DAY, f"c{i:02}", *map(float, r)) for i, r in enumerate(raw)] + [(DAY, "hole", None, 1.0, 1.0)], "date date, code string, x double, y double, z double")
    out = cross.orthogonalise(df.filter("code <> 'hole'"), ["x", "y", "z"]).toPandas()
    assert np.allclose(np.cov(out[["x", "y", "z"]].T), np.eye(3), atol=1e-9)
    same = df.withColumn("y", F.col("x"))
    assert cross.orthogonalise(same, ["x", "y", "z"]).filter("x is not null").count() == 0


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(DAY, f"c{i}", *map(float, r)) for i, r in enumerate(a)] + [(DAY, "null", None, 1.0, 1.0)], "date date, code string, y double, u double, v double")
    out = {r["code"]: r["fac"] for r in cross.regress_out(df, "y", ["u", "v"]).collect()}
    design = np.column_stack([np.ones(30), a[:, 1:]])
    want = a[:, 0] - design @ np.linalg.lstsq(design, a[:, 0], rcond=None)[0]
    assert np.allclose([out[f"c{i}"] for i in range(30)], want) and out["null"] is None


def test_box_cox_of_lognormal_values_is_near_the_logarithm(spark):
    x = np.exp(np.random.default_rng(3).normal(size=400))
    df = spark.createDataFrame([(DAY, str(i), float(v)) for i, v in enumerate(x)] + [(DAY, "zero", 0.0), (DAY + dt.timedelta(1), "a", -1.0), (DAY + dt.timedelta(1), "b", 2.0)], "date date, code string, fac double")
    out = values(cross.box_cox(df))
    assert np.corrcoef(np.log(x), [out[0, str(i)] for i in range(400)])[0, 1] > 0.99
    assert pd.isna(out[0, "zero"]) and pd.isna(out[1, "b"])


def loop(events):
    state, out = 0, []
    for lo, so in events:
        if state == 0:
            state = 1 if lo else -1 if so else 0
        elif state == 1 and so:
            state = -1
        elif state == -1 and lo:
            state = 1
        out.append(state)
    return out


def test_state_machines_walk_all_events(spark):
    events = [tuple(map(bool, e)) for e in np.random.default_rng(4).integers(0, 2, (60, 2))]
    df = spark.createDataFrame([(DAY + dt.timedelta(i), "a", *e) for i, e in enumerate(events)], "date date, code string, lo boolean, so boolean")
    out = values(timing.long_short_signal(df), "signal")
    assert [out[i, "a"] for i in range(60)] == loop(events)
    only = values(timing.long_signal(df), "signal")
    assert set(only.values()) <= {0, 1}


def test_account_buys_on_the_next_open_and_closes_at_the_end(spark):
    rows = [(DAY + dt.timedelta(i), "a", o, c, s) for i, (o, c, s) in enumerate([(10.0, 10.0, 1), (10.0, 12.0, 0), (12.0, 12.0, -1), (15.0, 15.0, 1), (20.0, 30.0, 0)])]
    df = spark.createDataFrame(rows, "date date, code string, open double, close double, signal int")
    out = values(timing.account(df, 105.0), "equity")
    assert [out[i, "a"] for i in range(5)] == [105.0, 125.0, 125.0, 155.0, 155.0 + 7 * 10.0]
    s = timing.account_stats(df, 105.0).first()
    assert (s["n_trades"], s["win"]) == (2, 1.0) and s["mean_ret"] == pytest.approx(0.5)


def test_adaptive_mean_matches_its_definition(spark):
    x = pd.Series(np.random.default_rng(5).normal(size=700).cumsum())
    want = [x[:10].mean()] * 10
    for i in range(10, 700):
        er = abs(x[i] - x[i - 10]) / sum(abs(x[j] - x[j - 1]) for j in range(i - 9, i + 1))
        want.append(want[-1] + (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - want[-1]))
    rows = [(DAY + dt.timedelta(i), "a", float(v)) for i, v in enumerate(x)] + [(DAY + dt.timedelta(i), "flat", 1.0) for i in range(20)] + [(DAY, "short", 5.0)]
    df = spark.createDataFrame(rows, "date date, code string, x double")
    out = series.adaptive_mean(df, "x", 10, "m").orderBy("code", "date").collect()
    assert np.allclose([r["m"] for r in out if r["code"] == "a"], want)
    assert [r["m"] for r in out if r["code"] == "flat"] == [1.0] * 20 and [r["m"] for r in out if r["code"] == "short"] == [None]
    stuck = series.adaptive_mean(df.filter("code = 'flat'"), "x", 10, "m", carry=False).orderBy("date").collect()
    assert [r["m"] for r in stuck] == [1.0] * 10 + [None] * 10


def test_normal_distribution_and_worked_positions(spark):
    import math

    xs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(columns.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(out, [(1 + math.erf(x / 2**0.5)) / 2 for x in xs], atol=1e-7)
    book = spark.createDataFrame([("b", 0.5, 50, 100), ("b", -0.3, 20, 100)], "book string, delta double, contracts int, multiplier int").withColumns({c: F.lit(0.0) for c in ("gamma", "vega", "theta")})
    assert options.share_equivalents(book).first()["sep"] == pytest.approx(2500 - 600)
    assert spark.range(1).select(options.theta_return(F.lit(25.0), F.lit(5000.0))).first()[0] == pytest.approx(1.26)


def test_returns_of_one_row_and_of_losses(spark):
    df = spark.createDataFrame([("one", DAY, 0.1, 0.0), ("down", DAY, -0.1, 0.0), ("down", DAY + dt.timedelta(1), -0.1, 0.01)], "strategy string, date date, ret double, bench double")
    out = {r["strategy"]: r for r in returns.performance(df).collect()}
    assert out["one"]["annual"] is None and out["one"]["vol"] == 0 and out["down"]["win"] == 0
    assert {r["strategy"]: r["drawdown"] for r in returns.drawdown_compound(df).filter(F.col("date") > DAY).collect()} == {"down": pytest.approx(0.1)}
    assert returns.detail(df).count() == 2 and returns.runs_test(df).count() == 2


def test_smart_money_without_smart_bars_is_null(spark):
    rows = [("a", DAY + dt.timedelta(d), d * 10 + i, 10.0 + i, 10.0 + i, 10.0 + i, v) for d in range(2) for i, v in enumerate([5, 0, 1])]
    bars = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume int")
    out = intraday.smart_money(bars, days=1, share=0.01)
    # The bar without volume has an infinite score; alone it is within any share, and its price has no weight.
    assert out.filter("q is not null").count() == 0 and out.count() == 10


def test_empty_tables_give_no_rows(spark):
    none = panel(spark, {"a": [1.0]}).filter("false")
    for out in (cross.zscore(none), cross.clip_mad(none), cross.quantile_group(none), cross.preprocess(none.withColumns({"circ_mv": F.lit(1.0), "industry": F.lit(1)})), series.smooth(none), cross.box_cox(none)):
        assert out.count() == 0


def test_masks_keep_rows_and_new_listings_go(spark):
    x = panel(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0]})
    status = spark.createDataFrame([(DAY, "a", 0), (DAY, "b", 1)], "date date, code string, status int")
    assert values(cross.mask_status(x, status)) == {(0, "a"): None, (1, "a"): 2.0, (0, "b"): 1.0, (1, "b"): 2.0}
    listing = spark.createDataFrame([("a", dt.date(2023, 12, 1)), ("b", dt.date(2000, 1, 1))], "code string, list_date date")
    assert {r["code"] for r in cross.without_new(x, listing).collect()} == {"b"}


def test_factors_keep_apart_when_run_together(spark):
    x = panel(spark, {"a": [1.0], "b": [3.0]})
    long = x.withColumn("factor_name", F.lit("p")).unionByName(x.withColumn("fac", F.col("fac") * 10).withColumn("factor_name", F.lit("q")))
    out = cross.over_factors(long, cross.zscore)
    assert {(r["factor_name"], r["code"]): round(r["fac"], 6) for r in out.collect()} == {("p", "a"): -0.707107, ("q", "a"): -0.707107, ("p", "b"): 0.707107, ("q", "b"): 0.707107}


def test_stream_appends_each_key_once(spark, tmp_path):
    from gridloom.streaming import ingest

    x = panel(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0]})
    x.unionByName(x).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest.ingest(ingest.daily_stream(spark, str(tmp_path / "in"), "date date, code string, fac double"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    readers.save_factor(x.withColumn("factor_name", F.lit("f")), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4


def test_codes_get_their_suffix(spark):
    df = spark.createDataFrame([("1",), ("600000",), ("830001",), ("1234567",)], "c string")
    assert [r[0] for r in df.select(columns.code_suffix(F.col("c"))).collect()] == ["000001.SZ", "600000.SH", "830001.BJ", "1234567"]
