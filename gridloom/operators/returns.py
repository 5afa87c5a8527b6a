"""Return and risk statistics; every series is keyed by ``strategy``, so any number is evaluated at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.columns import normal_cdf, ratio, steady


def strategy_rows() -> WindowSpec:
    return Window.partitionBy("strategy").orderBy("date")


def so_far() -> WindowSpec:
    return strategy_rows().rowsBetween(Window.unboundedPreceding, 0)


def net_values(rets: DataFrame) -> DataFrame:
    """Adds net (compounded), and for additive curves cum."""
    return rets.withColumns({"net": F.exp(F.sum(F.log1p("ret")).over(so_far())), "cum": F.sum("ret").over(so_far())})


def drawdown_compound(rets: DataFrame) -> DataFrame:
    """strategy, date, drawdown: the share lost from the highest compounded net value (0 or more)."""
    x = net_values(rets).withColumn("top", F.max("net").over(so_far()))
    return x.select("strategy", "date", (1 - F.col("net") / F.col("top")).alias("drawdown"))


def drawdown_additive(rets: DataFrame) -> DataFrame:
    """The same of 1 + the summed returns."""
    x = rets.withColumn("level", 1 + F.sum("ret").over(so_far())).withColumn("top", F.max("level").over(so_far()))
    return x.select("strategy", "date", (1 - ratio(F.col("level"), F.col("top"))).alias("drawdown"))


def drawdown_equity(equity: DataFrame) -> DataFrame:
    """The change from the highest equity so far (0 or less)."""
    return equity.select("strategy", "date", (ratio(F.col("equity"), F.max("equity").over(so_far())) - 1).alias("drawdown"))


def performance(rets: DataFrame, per_year: int = 252) -> DataFrame:
    """total (summed), annual (by calendar days), max_drawdown, vol (population), sharpe and win share."""
    dd = drawdown_additive(rets).groupBy("strategy").agg(F.max("drawdown").alias("max_drawdown"))
    days = F.datediff(F.max("date"), F.min("date"))
    x = rets.groupBy("strategy").agg(F.sum("ret").alias("total"), ratio(F.sum("ret") * 365, days).alias("annual"), (F.stddev_pop("ret") * F.sqrt(F.lit(per_year))).alias("vol"), (F.count_if(F.col("ret") > 0) / F.count("ret")).alias("win"))
    return x.join(dd, "strategy").withColumn("sharpe", ratio(F.col("annual"), F.col("vol")))


def relative_performance(rets: DataFrame, per_year: int = 252, bench: str = "bench") -> DataFrame:
    """The performance of the excess over the benchmark's return."""
    return performance(rets.select("strategy", "date", (F.col("ret") - F.col(bench)).alias("ret")), per_year)


def against_index(rets: DataFrame, levels: DataFrame, code: str, freq: str = "W", per_year: int = 52) -> DataFrame:
    """The performance of the excess over one index, chosen by ``code`` from levels (date, code, close).

    Levels are resampled to ``freq`` (D, W or M); returns are dated by its periods.  A row of 0 a period before
    the first one is counted, and both series keep each period's last value.
    """
    from gridloom.sources.readers import resample

    index = resample(levels.filter(F.col("code") == code), "close", freq).select("date", (ratio(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("date"))) - 1).alias("_index"))
    excess = rets.join(index, "date").select("strategy", "date", (F.col("ret") - F.col("_index")).alias("ret")).filter("ret is not null")
    return performance(start_at_zero(excess, freq), per_year)


def detail(rets: DataFrame, *, per_year: int = 250, risk_free: float = 0.02) -> DataFrame:
    """A row a strategy: total, annual, sigma, sharpe, max_drawdown, calmar, excess, alpha, beta, win, excess_win, and
    excess_annual, excess_sigma, excess_sharpe, excess_drawdown, years and bars.

    Returns compound; sigma is (e^std of log returns - 1) * sqrt(per_year); alpha and beta are of a least-squares
    line on the benchmark's returns, alpha in percent a year.  The excess a year is of its net value's last over
    its first, by calendar days.
    """
    dd = drawdown_compound(rets).groupBy("strategy").agg(F.max("drawdown").alias("max_drawdown"))
    lr, bars = F.log1p("ret"), F.count("ret")
    over = lr - F.log1p("bench")
    # The excess as a return of its own, for the same drawdown.
    gap = drawdown_compound(rets.select("strategy", "date", F.expm1(over).alias("ret"))).groupBy("strategy").agg(F.max("drawdown").alias("excess_drawdown"))
    years = F.datediff(F.max("date"), F.min("date")) / 365
    x = rets.groupBy("strategy").agg(
        F.expm1(F.sum(lr)).alias("total"), (F.exp(F.sum(lr) * per_year / bars) - 1).alias("annual"), (F.expm1(F.stddev_samp(lr)) * F.sqrt(F.lit(per_year))).alias("sigma"), F.expm1(F.sum(lr - F.log1p("bench"))).alias("excess"),
        (F.regr_intercept("ret", "bench") * per_year * 100).alias("alpha"), F.regr_slope("ret", "bench").alias("beta"), (F.count_if(F.col("ret") >= 0) / bars).alias("win"), (F.count_if(F.col("ret") > F.col("bench")) / bars).alias("excess_win"),
        F.expm1(ratio(F.sum(over) - F.min_by(over, "date"), years)).alias("excess_annual"), (F.expm1(F.stddev_samp(over)) * F.sqrt(F.lit(per_year))).alias("excess_sigma"), years.alias("years"), bars.alias("bars"),
    )
    x = x.join(dd, "strategy").join(gap, "strategy")
    return x.withColumns({"sharpe": ratio(F.col("annual") - risk_free, F.col("sigma")), "calmar": ratio(F.col("annual"), F.col("max_drawdown")), "excess_sharpe": ratio(F.col("excess_annual"), F.col("excess_sigma"))})


def detail_table(rets: DataFrame, **kw) -> DataFrame:
    """The detail as it is shown: shares in percent to one place, ratios to two, and runs_p, the runs test's p in percent."""
    x = detail(rets, **kw).join(runs_test(rets).select("strategy", F.col("p").alias("runs_p")), "strategy")
    pct = {"total": 1, "annual": 1, "excess_annual": 1, "win": 1, "excess_win": 1, "max_drawdown": 1, "excess_drawdown": 1, "sigma": 1, "runs_p": 2}
    shown = [steady(F.col(c) * 100, n).alias(c) for c, n in pct.items()] + [steady(F.col("alpha"), 1).alias("alpha")] + [steady(F.col(c), 2).alias(c) for c in ("beta", "sharpe", "excess_sharpe", "calmar")]
    return x.select("strategy", steady(F.col("years"), 1).alias("years"), "bars", *shown)


def between_dates(rets: DataFrame, start: str, end: str, **kw) -> DataFrame:
    """The detail of a slice of dates."""
    return detail(rets.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))), **kw)


def runs_test(rets: DataFrame) -> DataFrame:
    """strategy, z, p: Wald-Wolfowitz runs of gains and losses, two-sided, continuity-corrected under 50 rows."""
    up = F.col("ret") > 0
    x = rets.withColumns({"up": up, "turn": F.coalesce((up != F.lag(up).over(strategy_rows())).cast("int"), F.lit(1))})
    x = x.groupBy("strategy").agg(F.sum("turn").cast("double").alias("runs"), F.count_if("up").cast("double").alias("a"), F.count_if(~F.col("up")).cast("double").alias("b"))
    n = F.col("a") + F.col("b")
    mean = 2 * F.col("a") * F.col("b") / n + 1
    var = ratio((mean - 1) * (mean - 2), n - 1)
    gap = F.col("runs") - mean
    gap = F.when(n < 50, F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0))).otherwise(gap)
    z = ratio(gap, F.sqrt(var))
    return x.withColumn("z", z).select("strategy", "z", (2 * (1 - normal_cdf(F.abs("z")))).alias("p"))


def rolling_sharpe(rets: DataFrame, n: int = 35, risk_free: float = 0.02, annual_rate: bool = False) -> DataFrame:
    """Rolling mean over deviation of the return less the daily risk-free rate (the whole annual one with ``annual_rate``)."""
    w = strategy_rows().rowsBetween(-(n - 1), 0)
    x = F.col("ret") - (risk_free if annual_rate else risk_free / 250)
    return rets.select("strategy", "date", F.when(F.count("ret").over(w) >= n, ratio(F.avg(x).over(w), F.stddev_samp(x).over(w))).alias("sharpe"))


def rolling_returns(rets: DataFrame, half: int = 125, year: int = 250) -> DataFrame:
    """strategy, date and the compounded return of the last half year and year of rows."""
    x = net_values(rets)
    return x.select("strategy", "date", *[(ratio(F.col("net"), F.lag("net", n).over(strategy_rows())) - 1).alias(name) for name, n in (("half", half), ("year", year))])


def rolling_sharpes(rets: DataFrame, half: int = 125, year: int = 250) -> DataFrame:
    """strategy, date and the Sharpe ratio of log returns over the last half year and year of rows, both a year."""
    lr = F.log1p("ret")

    def over(n: int) -> Column:
        w = strategy_rows().rowsBetween(-(n - 1), 0)
        value = ratio(F.expm1(F.avg(lr).over(w) * year), F.expm1(F.stddev_samp(lr).over(w)) * F.sqrt(F.lit(year)))
        return F.when(F.count(lr).over(w) >= n, value)

    return rets.select("strategy", "date", over(half).alias("half"), over(year).alias("year"))


def by_period(rets: DataFrame, period: str, method: str = "total_return") -> DataFrame:
    """strategy, period and its return: total_return and total_lr (of logs) in percent, sum, or mul (the product)."""
    key = F.trunc("date", "month") if period == "month" else F.year("date")
    value = {"total_return": F.expm1(F.sum(F.log1p("ret"))) * 100, "total_lr": F.expm1(F.sum("ret")) * 100, "sum": F.sum("ret"), "mul": F.product("ret")}[method]
    return rets.groupBy("strategy", key.alias("period")).agg(value.alias("ret"))


def against_benchmark(rets: DataFrame, period: str) -> DataFrame:
    """by_period of the strategy and of its benchmark side by side, in percent."""
    key = F.trunc("date", "month") if period == "month" else F.year("date")
    pct = lambda c: F.expm1(F.sum(F.log1p(c))) * 100
    return rets.groupBy("strategy", key.alias("period")).agg(pct("ret").alias("ret"), pct("bench").alias("bench"))


def before(date: Column, freq: str) -> Column:
    """The date a day, a week or a month (D, W, M) earlier."""
    return {"D": F.date_sub(date, 1), "W": F.date_sub(date, 7), "M": F.add_months(date, -1)}[freq]


def start_at_zero(rets: DataFrame, freq: str = "D") -> DataFrame:
    """A row of 0 a period before each strategy's first."""
    first = rets.groupBy("strategy").agg(before(F.min("date"), freq).alias("date")).withColumn("ret", F.lit(0.0))
    return rets.select("strategy", "date", "ret").unionByName(first.select("strategy", "date", "ret"))


def positions(signals: DataFrame) -> DataFrame:
    """date, code, pos: signals (null: 0) over the sum of their sizes per date; null where all are 0."""
    s = F.coalesce(F.col("signal"), F.lit(0.0)).cast("double")
    return signals.select("date", "code", ratio(s, F.sum(F.abs(s)).over(Window.partitionBy("date"))).alias("pos"))


def position_returns(pos: DataFrame, rets: DataFrame, cost: float = 0.0002, signed: bool = False) -> DataFrame:
    """date, ret: returns earned by the positions less the cost of turnover (of its sign with ``signed``), for each date of ``pos``.

    Turnover is the change since the panel's date before.  A code without a row on a date holds nothing there, so
    its last position is given up; the first date, and what follows or is a date without positions (null), turns nothing over.
    """
    days = pos.groupBy("date").agg(F.bool_or(F.col("pos").isNotNull()).alias("live"))
    w = Window.orderBy("date")  # a row a date: small
    days = days.withColumns({"didx": F.row_number().over(w), "was": F.coalesce(F.lag("live").over(w), F.lit(False)), "next_date": F.lead("date").over(w), "next_live": F.lead("live").over(w)})
    grid = Window.partitionBy("code").orderBy("didx")
    x = pos.join(days, "date").withColumns({"_before": F.max("pos").over(grid.rangeBetween(-1, -1)), "_after": F.max(F.lit(1)).over(grid.rangeBetween(1, 1))})
    held = x.select("date", "code", "pos", F.when(F.col("was"), F.col("pos") - F.coalesce(F.col("_before"), F.lit(0.0))).otherwise(0.0).alias("turn"))
    left = x.filter("pos is not null and _after is null and next_live").select(F.col("next_date").alias("date"), "code", F.lit(0.0).alias("pos"), (-F.col("pos")).alias("turn"))
    cost_of = F.col("turn") if signed else F.abs("turn")
    earned = held.unionByName(left).join(rets.select("date", "code", "ret"), ["date", "code"]).groupBy("date").agg(F.sum(F.col("ret") * F.col("pos") - cost_of * cost).alias("ret"))
    return days.select("date").join(earned, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
