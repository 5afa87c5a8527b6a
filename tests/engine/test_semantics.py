"""Numbers worked by hand for operators whose definition is easy to get wrong, and connectors."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns, registry
from gridloom.operators import cross, evaluation, intraday, returns, series, timing
from gridloom.sources import readers
from gridloom.streaming import ingest

DAY = dt.date(2024, 1, 1)
day = lambda i: DAY + dt.timedelta(i)


def bars(spark, closes, volumes, amounts=None):
    amounts = amounts or [c * v for c, v in zip(closes, volumes, strict=True)]
    rows = [("a", day(0), i, float(c), float(c), float(c), v, float(m)) for i, (c, v, m) in enumerate(zip(closes, volumes, amounts, strict=True))]
    return spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume int, amount double")


def test_rounding_lets_large_values_and_infinities_through(spark):
    xs = [1e14, 1e300, float("inf"), float("-inf"), -2.5e-7, 0.1234565, -1.5]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(columns.steady(F.col("x"), 6)).collect()]
    assert out[:4] == [1e14, 1e300, float("inf"), float("-inf")] and out[4:] == [0.0, pytest.approx(0.123457), -1.5]
    assert math.isnan(spark.range(1).select(columns.steady(F.lit(float("nan")), 2)).first()[0])


def test_rounding_leaves_whole_numbers_of_its_unit_alone(spark):
    # In millionths these are whole and odd, between 2 ** 52 and 2 ** 53; then the largest number below a half.
    xs = [6271486243.774899, -7224558066.525381, 7867837064.370039, 0.49999999999999994]
    table = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in table.select(columns.steady(F.col("x"), 6)).collect()][:3] == xs[:3]
    assert [r[0] for r in table.select(columns.steady(F.col("x"), 0)).collect()] == [6271486244.0, -7224558067.0, 7867837064.0, 0.0]


def test_five_bar_sums_are_averaged(spark):
    closes = [1.0]
    for r in (0.1, 0.2, 0.0, -0.1, 0.3, 0.5, -0.2):  # five, and a rest of two
        closes.append(closes[-1] * (1 + r))
    out = intraday.return_factors(bars(spark, closes, [1] * 8)).first()
    assert out["rtn5_mean"] == pytest.approx((0.5 + 0.3) / 2) and out["real_var"] == pytest.approx(0.01 + 0.04 + 0.01 + 0.09 + 0.25 + 0.04)
    assert intraday.return_factors(bars(spark, closes[:4], [1] * 4)).first()["rtn5_mean"] is None


def test_a_low_of_zero_makes_the_range_infinite(spark):
    def vov2(closes):
        return intraday.volatility_factors(bars(spark, closes, [1] * len(closes))).first()["vov2"]

    # With a price of 0 in the last five of ten bars with a return; the bar after it has none.
    assert vov2([1, 2, 4, 2, 1, 2, 4, 2, 1, 2, 0]) == math.inf
    assert vov2([1, 2, 4, 2, 1, 2]) == pytest.approx(math.log(4) / math.sqrt(4 * math.log(2)))
    # Its bucket of its own, where the high is 0 too.
    assert math.isnan(vov2([1, 2, 4, 2, 1, 2, 0]))


def test_bars_of_one_place_share_their_cumulated_volume(spark):
    x = bars(spark, [1, 2, 2, 4], [1, 5, 7, 9]).withColumn("seq", F.least("seq", F.lit(1)) + F.when(F.col("seq") > 2, 1).otherwise(0))
    assert [r["seq"] for r in x.orderBy("close", "volume").collect()] == [0, 1, 1, 2]
    assert intraday.volume_factors(x).first()["cum_mean"] == (12 + 12 + 21) / 3  # the first bar has no return


def test_tail_shares_are_of_log_volume(spark):
    volumes = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]
    out = intraday.volume_factors(bars(spark, range(1, 13), volumes)).first()
    logs = [math.log(v + 1e-6) for v in volumes[1:]]  # the first bar has no return
    assert out["top_share"] == pytest.approx(logs[-1] / sum(logs)) and out["low_share"] == pytest.approx(logs[0] / sum(logs))


def test_a_day_s_first_bar_is_against_the_day_before(spark):
    rows = [("a", day(d), s, c) for d, s, c in ((0, 1, 10.0), (0, 2, 11.0), (1, 1, 22.0), (1, 2, 11.0))]
    x = spark.createDataFrame(rows, "code string, date date, seq long, close double")
    out = {(r["date"], r["seq"]): r["ret"] for r in intraday.with_returns(x).collect()}
    assert out[day(0), 1] is None and out[day(1), 1] == pytest.approx(1.0) and out[day(1), 2] == pytest.approx(-0.5)
    inside = {(r["date"], r["seq"]): r["ret"] for r in intraday.with_returns(x, within_day=True).collect()}
    assert inside[day(1), 1] is None


def test_quantile_days_are_chosen_by_mean_price(spark):
    rows = [("a", day(d), 1, 1.0, 1.0, 1.0, 10, 10.0 * price) for d, price in enumerate([5.0, 1.0, 3.0, 2.0])]
    x = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume int, amount double")
    daily = spark.createDataFrame([("a", day(d), r) for d, r in enumerate([0.1, 0.2, 0.4, 0.8])], "code string, date date, ret double")
    out = intraday.reverse_momentum(x, daily, days=4, top=1).first()
    assert (out["m_high"], out["m_low"]) == (0.1, 0.2)


def test_the_first_bar_of_a_window_has_no_rank(spark):
    rows = [("a", day(0), i, c, c, c, v, 1.0) for i, (c, v) in enumerate([(1.0, 2), (3.0, 100), (3.3, 2), (3.3, 3), (4.0, 2)])]
    x = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume int, amount double")
    out = {r["score"]: r["q"] for r in intraday.smart_money(x, days=1, share=0.5).collect()}
    # Bar 1 opens the window, holds 100 of 107 and would lead by volume; by s4 it comes last, so the other three are within the share.
    whole = (3.0 * 100 + 3.3 * 2 + 3.3 * 3 + 4.0 * 2) / 107
    assert out["s3"] is None and out["s4"] == pytest.approx((3.3 * 2 + 3.3 * 3 + 4.0 * 2) / 7 / whole)


def test_a_close_that_stands_still_adds_nothing(spark):
    rows = [("a", day(i), *x) for i, x in enumerate([(10.0, 8.0, 9.0, None, 100.0), (9.0, 8.0, 9.0, 9.0, 50.0), (12.0, 8.0, 10.0, 9.0, 10.0), (10.0, 8.0, 9.0, 10.0, 4.0), (9.5, 8.0, 9.5, 9.0, 1.0), (12.0, 8.0, 10.0, 9.5, 1.0)])]
    x = spark.createDataFrame(rows, "code string, date date, high double, low double, close double, pre_close double, vol double")
    out = {r["date"]: r["obv"] for r in series.money_flow_line(x).collect()}
    assert [out[day(i)] for i in range(6)] == [0.0, 0.0, 0.0, 0.0, None, None]
    up = x.filter(F.col("date") <= day(3)).withColumn("low", F.lit(7.0))
    assert [r["obv"] for r in series.money_flow_line(up).orderBy("date").collect()] == [0.0, 0.0, 10 * (3 - 2) / 2, 5.0 - 4 * (2 - 1) / 1]


def test_turnover_counts_exits_and_not_the_first_day(spark):
    pos = spark.createDataFrame([(day(0), "a", 0.5), (day(0), "b", 0.5), (day(1), "a", 1.0), (day(2), "a", None), (day(3), "a", 1.0)], "date date, code string, pos double")
    rets = spark.createDataFrame([(day(i), c, 0.1) for i in range(4) for c in "ab"], "date date, code string, ret double")
    out = {r["date"]: r["ret"] for r in returns.position_returns(pos, rets, cost=0.01).collect()}
    assert out == {day(0): pytest.approx(0.1), day(1): pytest.approx(0.1 - 0.01 * (0.5 + 0.5)), day(2): 0.0, day(3): pytest.approx(0.1)}
    signed = {r["date"]: r["ret"] for r in returns.position_returns(pos, rets, cost=0.01, signed=True).collect()}
    assert signed[day(1)] == pytest.approx(0.1)


def test_price_energy_looks_three_rows_back(spark):
    x = spark.createDataFrame([("a", day(i), float(100 + i), 1.0) for i in range(60)], "code string, date date, close double, vol double")
    out = {r["date"]: r["price_energy"] for r in series.resonance(x).collect()}
    mean = lambda i: sum(100 + j for j in range(i - 49, i + 1)) / 50
    assert out[day(52)] == pytest.approx(mean(52) / mean(49)) and out[day(51)] is None


def test_account_figures(spark):
    rows = [(day(i), "a", o, c, s) for i, (o, c, s) in enumerate([(10.0, 10.0, 1), (10.0, 12.0, -1), (10.0, 10.0, 1), (10.0, 10.0, -1), (8.0, 8.0, 0)])]
    s = timing.account_stats(spark.createDataFrame(rows, "date date, code string, open double, close double, signal int"), 100.0).first()
    equity = [100.0, 120.0, 100.0, 100.0, 80.0]
    r = [0.0] + [b / a - 1 for a, b in zip(equity, equity[1:], strict=False)]
    mean = sum(r) / 5
    spread = math.sqrt(sum((x - mean) ** 2 for x in r) / 4)
    assert s["total"] == pytest.approx(-0.2) and s["annual"] == pytest.approx(-0.2 / (4 / 365)) and s["sharpe"] == pytest.approx(mean / spread * math.sqrt(252))
    # A trade of 0 is neither a gain nor a loss.
    assert (s["n_trades"], s["win"], s["pl_ratio"], s["mean_ret"]) == (2, 0.0, None, pytest.approx(-0.1)) or math.isnan(s["pl_ratio"])


def test_the_grid_is_of_both_counts(spark):
    panel = spark.createDataFrame([(day(i), f"c{k}", 100.0 * (1.2 if k < 3 else 0.7) ** i) for i in range(6) for k in range(5)], "date date, code string, close double")
    index = spark.createDataFrame([(day(i), "x", 10.0 + i, 10.5 + i) for i in range(6)], "date date, code string, open double, close double")
    out = {(r["pos_num"], r["neg_num"]): r for r in timing.grid_search(index, panel, [2, 3], [1, 2], cash=100.0, window=2, back=1, up=0.1, down=-0.1).collect()}
    assert set(out) == {(2, 1), (2, 2), (3, 1), (3, 2)}
    assert out[2, 1]["n_trades"] == 1 and out[3, 1]["n_trades"] == 0 and [k for k, r in out.items() if r["best"]] == [(2, 1)]


def test_signals_with_closing_events_of_their_own(spark):
    rows = [(day(i), "a", *e) for i, e in enumerate([(True, False, False, False), (False, True, False, False), (False, True, True, False), (False, False, False, True), (True, True, False, False)])]
    x = spark.createDataFrame(rows, "date date, code string, lo boolean, so boolean, lc boolean, sc boolean")
    assert [r["signal"] for r in timing.long_short_signal(x).orderBy("date").collect()] == [1, 1, -1, 0, 1]
    assert [r["signal"] for r in timing.long_signal(x).orderBy("date").collect()] == [1, 1, 0, 0, 1]


def test_holes_of_the_grid_are_missing(spark):
    x = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 1.0), (day(1), "a", 1.0)], "date date, code string, fac double")
    both = lambda d: (cross.has_missing(d).first()[0], cross.grid_has_missing(d).first()[0], cross.has_missing(series.densify(d)).first()[0])
    assert both(x) == (False, True, True) and both(x.filter("code = 'a'")) == (False, False, False)
    assert both(x.withColumn("fac", F.lit(None).cast("double"))) == (True, True, True)


def test_a_clip_of_zero_is_no_default(spark):
    x = spark.createDataFrame([(DAY, c, v) for c, v in zip("abc", [1.0, 2.0, 9.0], strict=True)], "date date, code string, fac double")
    assert {r["code"]: r["fac"] for r in cross.clip(x, "mad", 0.0).collect()} == {"a": 2.0, "b": 2.0, "c": 2.0}


def test_long_short_figures_by_hand(spark):
    ls = spark.createDataFrame([(day(i), x, x, 0.0, sum([0.1, -0.1, 0.3, 0.1][: i + 1])) for i, x in enumerate([0.1, -0.1, 0.3, 0.1])], "date date, ls double, inner_long double, inner_short double, net double")
    r = evaluation.long_short_stats(ls, 4).first()
    # Five net values with the row of 0 in front, but the deviation of four: mean 0.1, squares 0, 0.04, 0.04, 0.
    assert math.isclose(r["annual_ret"], 0.4 * 4 / 5) and math.isclose(r["vol"], math.sqrt(0.02) * 2) and math.isclose(r["ir"], 0.32 / (math.sqrt(0.02) * 2))
    assert math.isclose(r["inner_long"], 0.32) and r["inner_short"] == 0


def test_coverage_divides_totals_by_hand(spark):
    fac = [(day(0), "a", 1.0), (day(0), "b", -1.0), (day(0), "c", -2.0), (day(1), "a", 3.0), (day(1), "d", -1.0), (day(2), "a", None), (day(1), "b", 0.0)]
    prices = [(day(0), c, 1.0) for c in "abcde"] + [(day(1), "a", 1.0), (day(1), "b", 0.0), (day(1), "c", 2.0)] + [(day(2), c, 1.0) for c in "abcde"]
    r = evaluation.coverage(spark.createDataFrame(fac, "date date, code string, fac double"), spark.createDataFrame(prices, "date date, code string, open double")).first()
    # Six values over 5 + 2 prices (a price of 0 is none, the third date has no value); two of five signs are up.
    assert math.isclose(r["coverage"], 6 / 7) and math.isclose(r["positive"], 2 / 5)


def test_an_index_is_averaged_over_the_factor_s_dates(spark):
    days = [day(31 * i) for i in range(4)]
    panel = spark.createDataFrame([(d, f"c{k}", float(k), 10.0 * 1.1**i) for i, d in enumerate(days) for k in range(4)], "date date, code string, fac double, open double")
    index = spark.createDataFrame([(d, x) for d, x in zip(days, [0.4, 0.1, 0.1, 0.2], strict=True)], "date date, ret double")
    out = {r["metric"]: r["value"] for r in evaluation.factor_summary(panel.select("date", "code", "fac"), panel.select("date", "code", "open"), 4, "M", index=index).collect()}
    assert math.isclose(out["first_excess"], (0.1 - 0.2) * 12)  # all four dates: also the first, which has no pair


def test_a_daily_factor_is_resampled_before_the_lag(spark):
    # Two codes, three weeks of five days: the factor's last value of a week meets the next week's first opens.
    rows = [(day(7 * w + d), c, float(w * 10 + d + (5 if c == "b" else 0)), 100.0 + (w if c == "a" else 2 * w) * 10 + d) for w in range(3) for d in range(5) for c in "ab"]
    x = spark.createDataFrame(rows, "date date, code string, fac double, open double")
    out = evaluation.evaluate(x.select("date", "code", "fac"), x.select("date", "code", "open"), 2, freq="W").orderBy("date").collect()
    opens = {(r[0], r[1]): r[3] for r in rows}
    weeks = sorted({r[0].isocalendar()[:2] for r in rows})
    first = {(w, c): min((r[0], r[3]) for r in rows if r[0].isocalendar()[:2] == w and r[1] == c)[1] for w in weeks for c in "ab"}
    want = [(first[b, "b"] / first[a, "b"]) - (first[b, "a"] / first[a, "a"]) for a, b in zip(weeks, weeks[1:])]
    assert opens and [round(r["ls"], 12) for r in out] == [round(w, 12) for w in want]
    assert evaluation.evaluate(x.select("date", "code", "fac"), x.select("date", "code", "open"), 2, freq="W", start="2100-01-01").count() == 0


def test_a_position_ends_at_expiry_near_the_strike(spark):
    from gridloom.operators import options

    rows = [("near", day(3), day(3), 101.0, 100.0), ("edge", day(3), day(3), 99.0, 100.0), ("far", day(3), day(3), 101.1, 100.0), ("early", day(2), day(3), 100.0, 100.0), ("no strike", day(3), day(3), 100.0, None)]
    x = spark.createDataFrame(rows, "opt_id string, date date, expiry date, s double, k double")
    want = {"near": True, "edge": True, "far": False, "early": False, "no strike": None}
    assert {r["opt_id"]: r["close"] for r in options.close_at_expiry(x).collect()} == want
    assert {r["opt_id"] for r in options.close_at_expiry(x, str(day(3))).filter("close").collect()} == {"near", "edge", "early"}


def test_summary_has_twelve_rows_and_frequencies_are_known(spark):
    panel = spark.createDataFrame([(day(31 * i), f"c{k:02}", float((k * 7 + i * 3) % 11 + 1), float(10 + (k * i) % 5)) for i in range(8) for k in range(12)], "date date, code string, fac double, open double")
    out = evaluation.factor_summary(panel.select("date", "code", "fac"), panel.select("date", "code", "open"), 4, "M").collect()
    assert [r["metric"] for r in out] == list(evaluation.SUMMARY) and evaluation.per_year("W") == 52
    with pytest.raises(ValueError):
        evaluation.per_year("Q")


def test_database_tables_are_appended_and_read_in_parts(spark):
    url, options = "jdbc:derby:memory:gridloom;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    x = spark.createDataFrame([(i, f"c{i}", float(i)) for i in range(10)], "id long, code string, fac double")
    readers.append_jdbc(x, url, "factor", options=options)
    readers.append_jdbc(x.filter("id < 3"), url, "factor", options=options)
    out = readers.jdbc_table(spark, url, "factor", column="id", bounds=("0", "10"), parts=3, options=options)
    assert out.rdd.getNumPartitions() == 3 and out.count() == 13 and out.agg(F.sum("fac")).first()[0] == 48.0


def test_files_tables_and_partitions(spark, tmp_path):
    x = spark.createDataFrame([(day(i), c, float(i), "size") for i in range(3) for c in "ab"], "date date, code string, fac double, style string")
    readers.append_table(x, str(tmp_path / "t"))
    readers.rewrite_partitions(x.filter(F.col("date") == day(1)).withColumn("fac", F.lit(9.0)), str(tmp_path / "t"))
    assert sorted(r["fac"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0.0, 0.0, 2.0, 2.0, 9.0, 9.0]
    x.write.partitionBy("style").parquet(str(tmp_path / "s"))
    assert readers.style_factor(spark, str(tmp_path / "s"), "size").count() == 6 and readers.style_factor(spark, str(tmp_path / "s"), "other").count() == 0
    assert readers.minute_bars(spark, str(tmp_path / "t"), "2024-01-02", "2024-01-02").count() == 2
    readers.create_table(spark, "loaded", {"date": "date", "code": "string"})
    readers.create_table(spark, "loaded", {"date": "date", "code": "string"})
    assert spark.table("loaded").columns == ["date", "code"]
    readers.drop_table(spark, "loaded")
    assert not spark.catalog.tableExists("loaded")


def test_vendor_exports_lose_titles_and_keep_the_last(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Stkcd,Trddt,Close,Junk\ncode,date,close,x\nno,no,yuan,x\n000001,2024-01-01,1.5,q\n000001,2024-01-02,1.6,q\n")
    (tmp_path / "2.csv").write_text("Stkcd,Trddt,Close,Junk\ncode,date,close,x\nno,no,yuan,x\n000001,2024-01-02,1.7,q\n")
    raw = readers.vendor_export(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], ["code", "date", "close"], drop=("Junk",))
    out = readers.read_exports(raw, "_file").select("code", "date", "close").orderBy("date")
    assert [tuple(r) for r in out.collect()] == [("000001", "2024-01-01", "1.5"), ("000001", "2024-01-02", "1.7")]


def test_loads_know_the_calendar(spark):
    calendar = spark.createDataFrame([(day(0), True), (day(1), False)], "cal_date date, is_open boolean")
    assert [readers.is_open_day(calendar, str(day(i))) for i in range(3)] == [True, False, False]


def test_a_stream_takes_any_sink(spark, tmp_path):
    x = spark.createDataFrame([(day(i), "a", float(i)) for i in range(3)], "date date, code string, fac double")
    x.write.parquet(str(tmp_path / "in"))
    seen = []
    ingest.ingest_with(ingest.daily_stream(spark, str(tmp_path / "in"), "date date, code string, fac double"), lambda df, n: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(60)
    assert sum(seen) == 3


def test_built_in_and_own_factors_are_computed_by_name(spark):
    assert {"pv_returns", "pv_volume", "pv_bars15", "pv_vov", "smart_money", "reverse_m"} <= set(registry.FACTORS)

    @registry.factor("last_close")
    def last_close(x):
        return x.groupBy("date", "code").agg(F.max_by("close", "seq").alias("fac")).withColumn("factor_name", F.lit("last_close"))

    out = registry.compute(bars(spark, [1, 2, 3, 4, 5, 6], [1] * 6), ["last_close", "pv_returns"], clear=lambda df: df.filter("fac is not null"))
    found = {r["factor_name"]: r["fac"] for r in out.collect()}
    assert found["last_close"] == 6.0 and "rtn5_mean" in found
    del registry.FACTORS["last_close"]


def test_recombined_pieces(spark):
    x = spark.createDataFrame([(DAY, "a", 1.0, 2.0)], "date date, code string, u double, v double")
    cells = cross.zip_factors(x, ["u", "v"])
    assert [(r["n"], r["fac"]) for r in columns.list_cells(cells).orderBy("n").collect()] == [(0, 1.0), (1, 2.0)]
    assert returns.start_at_zero(spark.createDataFrame([("s", dt.date(2024, 3, 31), 0.5)], "strategy string, date date, ret double"), "M").filter("ret = 0").first()["date"] == dt.date(2024, 2, 29)
    rets = spark.createDataFrame([("s", day(i), r, 0.0) for i, r in enumerate([0.1, -0.05, 0.02, 0.03, -0.01])], "strategy string, date date, ret double, bench double")
    shown = returns.detail_table(rets).first()
    assert shown["total"] == pytest.approx(round((1.1 * 0.95 * 1.02 * 1.03 * 0.99 - 1) * 100, 1)) and shown["bars"] == 5 and shown["win"] == 60.0
    assert returns.drawdown_equity(spark.createDataFrame([("s", day(0), 10.0), ("s", day(1), 8.0)], "strategy string, date date, equity double")).orderBy("date").collect()[1]["drawdown"] == pytest.approx(-0.2)
