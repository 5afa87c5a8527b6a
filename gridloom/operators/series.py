"""Operators along each code's dates: grid-aware shifts and windows, indicators and recursions.

A shift or a window steps over the dates of the whole panel, whether a code has them or not:
``on_grid`` numbers the dates, and frames are ranges of that number, so nothing is densified.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.columns import ratio
from gridloom.functions.registry import grouped_apply
from gridloom.operators.scans import affine_scan, ema_steps


def code_window() -> WindowSpec:
    return Window.partitionBy("code")


def code_rows() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def on_grid(panel: DataFrame) -> DataFrame:
    """Adds didx, the number of the date among the panel's dates (numbered on the distinct dates, a small table)."""
    days = panel.select("date").distinct().withColumn("didx", F.row_number().over(Window.orderBy("date")))
    return panel.join(days, "date")


def densify(panel: DataFrame) -> DataFrame:
    """All dates by all codes, with nulls where the panel has no row."""
    return panel.select("date").distinct().crossJoin(panel.select("code").distinct()).join(panel, ["date", "code"], "left")


def shifted(col: str, k: int = 1) -> Column:
    """The value ``k`` grid dates before (after, if negative), null if the code has no row there."""
    return F.max(col).over(code_window().orderBy("didx").rangeBetween(-k, -k))


def lagged(col: str, k: int = 1) -> Column:
    """The value of the code's row ``k`` rows before (after, if negative)."""
    return F.lag(col, k).over(code_rows()) if k >= 0 else F.lead(col, -k).over(code_rows())


def rolling(col: Column | str, n: int, fn: Callable = F.avg, min_periods: int | None = None, *, grid: bool = True) -> Column:
    """``fn`` over the last n dates of the grid (or rows), null with fewer than ``min_periods`` values."""
    col = F.col(col) if isinstance(col, str) else col
    w = code_window().orderBy("didx").rangeBetween(-(n - 1), 0) if grid else code_rows().rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(w) >= (n if min_periods is None else min_periods), fn(col).over(w))


def smooth(panel: DataFrame, n: int = 20, col: str = "fac", weekly: bool = False) -> DataFrame:
    """Rolling mean with half the window at least; weekly keeps each week's last value."""
    from gridloom.sources.readers import resample

    out = on_grid(panel).withColumn(col, rolling(col, n, min_periods=int(0.5 * n))).drop("didx")
    return resample(out, col, "W") if weekly else out


def volatility_of_z(panel: DataFrame, n: int = 40, min_periods: int = 20, col: str = "fac") -> DataFrame:
    """Rolling deviation of the cross-section z-score."""
    from gridloom.operators.cross import zscore

    return on_grid(zscore(panel, col)).withColumn(col, rolling(col, n, F.stddev_samp, min_periods)).drop("didx")


def forward_returns(daily: DataFrame) -> DataFrame:
    """date, code and the returns a signal can still earn: open to open, close to close, overnight, in the day."""
    o, c = (lambda k: lagged("open", -k)), (lambda k: lagged("close", -k))
    return daily.select("date", "code", (ratio(o(2), o(1)) - 1).alias("ret_open"), (ratio(c(1), F.col("close")) - 1).alias("ret_close"), (ratio(o(1), F.col("close")) - 1).alias("ret_overnight"), (ratio(c(1), o(1)) - 1).alias("ret_inday"))


def money_flow_line(daily: DataFrame) -> DataFrame:
    """Adds obv: volume weighed by the close's place in the range, signed by the change, cumulated.

    A row whose close doesn't change, or has none before it, adds 0.  A row that changes and closes at its high is
    null, and so are all rows behind it, as a running sum has it.
    """
    flow = F.col("vol") * ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("close"))
    out = daily.withColumn("_flow", F.when(F.col("close") > F.col("pre_close"), flow).when(F.col("close") < F.col("pre_close"), -flow).otherwise(0.0))
    run = code_rows().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("obv", F.when(F.count_if(F.col("_flow").isNull()).over(run) == 0, F.sum("_flow").over(run))).drop("_flow")


def volume_index(daily: DataFrame, up: bool = True, reset: bool = False, out: str = "value") -> DataFrame:
    """Adds the positive (``up``) or negative volume index from 1000.

    Days whose volume moved that way compound the return; on others the level is carried, or starts again at
    1000 with ``reset``.
    """
    move = F.col("vol") - lagged("vol")
    flagged = daily.withColumn("_hit", F.coalesce(move > 0 if up else move < 0, F.lit(False)))
    flagged = flagged.withColumn("_ln", F.when(F.col("_hit"), F.ln(1 + F.col("pct_change"))).otherwise(0.0))
    run = code_rows().rowsBetween(Window.unboundedPreceding, 0)
    if reset:
        flagged = flagged.withColumn("_run", F.count_if(~F.col("_hit")).over(run))
        run = Window.partitionBy("code", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn(out, 1000 * F.exp(F.sum("_ln").over(run))).drop("_hit", "_ln", "_run")


def weighted_mean4(col: str = "close", newest: bool = False) -> Column:
    """Four-row weighted mean; the oldest row weighs most, or the newest with ``newest``."""
    weights = (4, 3, 2, 1) if newest else (1, 2, 3, 4)
    return sum((lagged(col, i) * w / 10 for i, w in enumerate(weights)), F.lit(0.0))


def short_state(daily: DataFrame, newest: bool = False) -> DataFrame:
    """Adds wma, momentum (ten rows) and short: falling momentum below a falling trend (5 against 90 rows)."""
    out = daily.withColumn("wma", weighted_mean4(newest=newest)).withColumn("momentum", F.col("wma") - lagged("wma", 10))
    trend = rolling("close", 5, grid=False) < rolling("close", 90, grid=False)
    return out.withColumn("short", F.coalesce((F.col("momentum") < 0) & trend, F.lit(False)))


def down_market(daily: DataFrame, threshold: float = 50.0, newest: bool = False) -> DataFrame:
    """Adds efficiency (net against gross move of ten rows, in percent) and status: 0 in an efficient fall, else 1."""
    out = daily.withColumn("wma", weighted_mean4(newest=newest))
    out = out.withColumn("momentum", F.col("wma") - lagged("wma", 10)).withColumn("_step", F.abs(F.col("wma") - lagged("wma")))
    out = out.withColumn("efficiency", ratio(F.abs("momentum"), rolling("_step", 10, F.sum, grid=False)) * 100)
    falls = (F.col("efficiency") > threshold) & (F.col("momentum") < 0)
    return out.withColumn("status", F.when(falls, 0).otherwise(1)).drop("_step")


def per_code(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], added: str, key: str = "code") -> DataFrame:
    """``fn`` on each code's rows in order of date, for recursions that no window expresses; ``added`` is the new columns' DDL."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return grouped_apply(df, [key], lambda g: fn(g.sort_values("date", ignore_index=True)), f"{kinds}, {added}")


def adaptive_mean(daily: DataFrame, col: str, period: int, out: str, fast: int = 2, slow: int = 30, carry: bool = True) -> DataFrame:
    """Adds the adaptive moving average: the more efficient the move, the faster it follows; seeded with the first mean.

    The rows up to the ``period``-th have the seed, null if there are fewer.  Where nothing moved in ``period`` rows the
    last value is carried, or everything behind is null without ``carry``.
    """
    quick, idle = 2 / (fast + 1), 2 / (slow + 1)
    x = daily.withColumns({"_place": F.row_number().over(code_rows()), "_mean": rolling(col, period, grid=False), "_move": F.abs(F.col(col) - lagged(col)), "_net": F.abs(F.col(col) - lagged(col, period))})
    x = x.withColumn("_gross", rolling("_move", period, F.sum, grid=False))
    speed = F.pow(ratio(F.col("_net"), F.col("_gross")) * (quick - idle) + idle, 2)
    x = x.withColumn("_speed", F.when(F.col("_place") > period, speed))
    x = affine_scan(x, {out: (1 - F.col("_speed"), F.col("_speed") * F.col(col), F.when(F.col("_place") == period, F.col("_mean")))})
    seed = F.max(F.when(F.col("_place") == period, F.col(out))).over(code_window())
    value = F.when(F.col("_place") < period, seed).otherwise(F.col(out))
    if not carry:
        stuck = (F.col("_place") > period) & F.col("_speed").isNull()
        value = F.when(F.count_if(stuck).over(code_rows().rowsBetween(Window.unboundedPreceding, 0)) == 0, value)
    return x.withColumn(out, value).drop("_place", "_mean", "_move", "_net", "_gross", "_speed")


def trend_strength(daily: DataFrame) -> DataFrame:
    """Adds trend (EMA10 / EMA26), accelerator (trend / EMA12 of it), ``short_state``'s columns, and long: both above 1 and not short."""
    x = affine_scan(daily, {"_fast": ema_steps(F.col("close"), 10), "_slow": ema_steps(F.col("close"), 26)})
    x = x.withColumn("trend", ratio(F.col("_fast"), F.col("_slow"))).drop("_fast", "_slow")
    x = affine_scan(x, {"_smooth": ema_steps(F.col("trend"), 12)})
    out = short_state(x.withColumn("accelerator", ratio(F.col("trend"), F.col("_smooth"))).drop("_smooth"))
    return out.withColumn("long", (F.col("trend") > 1) & (F.col("accelerator") > 1) & ~F.col("short"))


def resonance(daily: DataFrame, *, ama: int = 10, bull: float = 1.125, bear: float = 1.275) -> DataFrame:
    """Adds price_energy, volume_energy, resonance and long.

    Energies compare a smoothed price with its value three rows back and a fast with a slow mean of the adaptive
    mean of volume.  In a rising trend (5 above 90 rows) the product must exceed ``bull``, else ``bear``.
    """
    out = adaptive_mean(daily, "vol", ama, "ama_vol").withColumn("bma", rolling("close", 50, grid=False))
    out = out.withColumn("price_energy", ratio(F.col("bma"), lagged("bma", 3)))
    out = out.withColumn("volume_energy", ratio(rolling("ama_vol", 5, grid=False), rolling("ama_vol", 100, grid=False)))
    out = out.withColumn("resonance", F.col("price_energy") * F.col("volume_energy"))
    rises = rolling("close", 5, grid=False) > rolling("close", 90, grid=False)
    return out.withColumn("long", F.coalesce(F.when(rises, F.col("resonance") > bull).otherwise(F.col("resonance") > bear), F.lit(False)))


def combined_rule(daily: DataFrame) -> DataFrame:
    """Adds ``combined``: the resonance rule or the trend rule while 5 rows' mean is above 90 rows', else the resonance rule alone."""
    trend = trend_strength(daily).select("date", "code", F.col("long").alias("_trend"))
    x = resonance(daily).join(trend, ["date", "code"])
    rises = F.coalesce(rolling("close", 5, grid=False) > rolling("close", 90, grid=False), F.lit(False))
    return x.withColumn("combined", combined_long(F.col("long"), F.col("_trend"), rises)).drop("_trend")


def combined_long(v: Column, trend: Column, rises: Column) -> Column:
    """In a rising market either signal, else only the first."""
    return F.when(rises, v | trend).otherwise(v)


def rolling_days(bars: DataFrame, days: int) -> DataFrame:
    """Overlapping batches: each row once for every window of ``days`` of its code's days that holds it (window_end)."""
    own = bars.select("code", "date").distinct().withColumn("d", F.row_number().over(code_rows()))
    ends = own.select("code", F.col("date").alias("window_end"), F.col("d").alias("end"))
    spread = own.select("code", "date", F.explode(F.sequence(F.col("d"), F.col("d") + days - 1)).alias("end")).join(ends, ["code", "end"]).filter(f"end >= {days}")
    return bars.join(spread.drop("end"), ["code", "date"])
