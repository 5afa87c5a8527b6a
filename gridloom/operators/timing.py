"""Timing signals: quantile events, state machines, position rules, and a cash account."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import ratio
from gridloom.functions.registry import grouped_apply
from gridloom.operators.rolling_order import rolling_quantiles
from gridloom.operators.scans import state_scan
from gridloom.operators.series import code_rows, lagged, per_code, rolling


def quantile_events(x: DataFrame, col: str, *, low: float = 0.2, high: float = 0.8, days: int = 365, burn_in: int = 365) -> DataFrame:
    """Adds lo (above the upper) and so (below the lower quantile of the trailing calendar window), after a burn-in."""
    x = rolling_quantiles(x, col, {"_high": high, "_low": low}, days)
    first = F.min("date").over(Window.partitionBy("code"))
    x = x.withColumns({"lo": F.col(col) > F.col("_high"), "so": F.col(col) < F.col("_low"), "_first": first}).drop("_high", "_low")
    return x.filter(F.col("date") >= F.date_add("_first", burn_in)).drop("_first")


def level_events(x: DataFrame, col: str, below: float, above: float, second: str | None = None, c: float | None = None, d: float | None = None) -> DataFrame:
    """Adds lo (at ``above`` or more) and so (at ``below`` or less); a second factor gives sc and lc."""
    x = x.withColumns({"lo": F.col(col) >= above, "so": F.col(col) <= below})
    return x if second is None else x.withColumns({"sc": F.col(second) <= c, "lc": F.col(second) >= d})


def _events(x: DataFrame) -> DataFrame:
    """lo, so, lc, sc without nulls; closing a long is opening a short and the other way round, if not given."""
    out = x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("lo", "so")})
    return out.withColumns({"lc": F.coalesce(F.col("lc") if "lc" in x.columns else F.col("so"), F.lit(False)), "sc": F.coalesce(F.col("sc") if "sc" in x.columns else F.col("lo"), F.lit(False))})


def _since_forced(x: DataFrame, forced: Column, turn: Column) -> DataFrame:
    """Adds _last, the last value that an event forced whatever the state was, and _turns, how often it was turned round since."""
    run = code_rows().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_f": forced, "_t": F.count_if(turn).over(run)})
    x = x.withColumns({"_last": F.last("_f", ignorenulls=True).over(run), "_from": F.last(F.when(F.col("_f").isNotNull(), F.col("_t")), ignorenulls=True).over(run)})
    return x.withColumn("_turns", F.col("_t") - F.coalesce("_from", F.lit(0))).drop("_f", "_t", "_from")


def long_short_signal(x: DataFrame) -> DataFrame:
    """Adds signal 1, 0 or -1: lo opens a long (before so a short), lc closes it (to a short on so), sc a short (to a long on lo).

    Without lc and sc of their own one event alone forces the state and both together turn it round (from 0 to a long),
    so windows tell it; with them each row is a map of the three states, and the maps are composed.
    """
    if "lc" in x.columns or "sc" in x.columns:
        e = _events(x)
        lo, so, lc, sc = (F.col(c) for c in ("lo", "so", "lc", "sc"))
        opened = F.when(lo, 1).when(so, -1).otherwise(0)
        closed_long, closed_short = F.when(lc, F.when(so, -1).otherwise(0)).otherwise(1), F.when(sc, F.when(lo, 1).otherwise(0)).otherwise(-1)
        return state_scan(e, {0: opened, 1: closed_long, -1: closed_short}, 0)
    e = _events(x)
    lo, so = F.col("lo"), F.col("so")
    e = _since_forced(e, F.when(lo & ~so, 1).when(so & ~lo, -1), lo & so)
    odd = F.col("_turns") % 2 == 1
    signal = F.when(F.col("_last").isNotNull(), F.when(odd, -F.col("_last")).otherwise(F.col("_last"))).when(F.col("_turns") == 0, 0).when(odd, 1).otherwise(-1)
    return e.withColumn("signal", signal.cast("int")).drop("_last", "_turns")


def long_signal(x: DataFrame) -> DataFrame:
    """Adds signal 1 or 0: lo opens, lc closes.  One of them forces the state, both turn it round."""
    lo, lc = F.col("lo"), F.col("lc")
    e = _since_forced(_events(x), F.when(lo & ~lc, 1).when(lc & ~lo, 0), lo & lc)
    return e.withColumn("signal", ((F.coalesce("_last", F.lit(0)) + F.col("_turns")) % 2).cast("int")).drop("_last", "_turns")


def _clamped(s: Column) -> Column:
    return F.when(s >= 0, 1.0).when(s <= -1, 0.0).when(s.isNotNull(), 1 + s)


def mean_reversion(x: DataFrame, col: str, window: int = 252) -> DataFrame:
    """Adds signal: 1 + the relative gap to the rolling mean, from 0 to 1."""
    mean = rolling(col, window, grid=False)
    return x.withColumn("signal", _clamped(ratio(F.col(col) - mean, mean)))


def range_position(x: DataFrame, col: str, window: int = 252) -> DataFrame:
    """Adds signal: 1 + (value over the rolling range - 1), from 0 to 1."""
    span = rolling(col, window, F.max, grid=False) - rolling(col, window, F.min, grid=False)
    return x.withColumn("signal", _clamped(ratio(F.col(col), span) - 1))


def one_signal(x: DataFrame, col: str, kind: int, start: str | None = None) -> DataFrame:
    """Rule 0 long-short, 1 long only (both from events), 2 mean reversion, 3 range position; rows from ``start``."""
    rule = {0: long_short_signal, 1: long_signal, 2: lambda d: mean_reversion(d, col), 3: lambda d: range_position(d, col)}[kind]
    out = rule(x)
    return out if start is None else out.filter(F.col("date") >= F.to_date(F.lit(start)))


def movers(panel: DataFrame, back: int = 20, up: float = 0.5, down: float = -0.3) -> DataFrame:
    """date, pos, neg: how many codes rose above ``up`` or fell below ``down`` in ``back`` rows."""
    x = panel.withColumn("chg", ratio(F.col("close"), lagged("close", back)) - 1)
    return x.groupBy("date").agg(F.count_if(F.col("chg") > up).alias("pos"), F.count_if(F.col("chg") < down).alias("neg"))


def _effect(pos_num: Column, neg_num: Column) -> Column:
    return F.when(F.col("pos") > pos_num, 1).when(F.col("neg") > neg_num, -1).otherwise(0)


def market_effect(panel: DataFrame, back: int = 20, up: float = 0.5, down: float = -0.3, pos_num: int = 50, neg_num: int = 50) -> DataFrame:
    """date, pos, neg, effect: 1 if more than ``pos_num`` codes rose, else -1 if more than ``neg_num`` fell, else 0."""
    return movers(panel, back, up, down).withColumn("effect", _effect(F.lit(pos_num), F.lit(neg_num)))


def effect_signals(index: DataFrame, effect: DataFrame, window: int = 20) -> DataFrame:
    """Index rows with ma and signal: 1 above the mean on effect 1, -1 on effect -1, else 0.  Columns of ``effect`` but its counts stay."""
    x = index.withColumn("ma", rolling("close", window, grid=False)).join(effect.drop("pos", "neg"), "date", "left")
    return x.withColumn("signal", F.when(F.col("effect") == -1, -1).when((F.col("effect") == 1) & (F.col("close") > F.col("ma")), 1).otherwise(0))


def next_after(left: DataFrame, right: DataFrame, keys: list[str], date: str = "date", *, strict: bool = True) -> DataFrame:
    """Each row of ``left`` with the columns of the first row of ``right`` of the same keys after its date (from its date on, if not ``strict``); null without one.

    The tables are laid together and read once backwards in time: no pairs are made, whatever lies between.  ``right``
    has a date once for each key; its date comes as ``next_date``, and its other columns must have names of their own.  Null keys or dates meet nothing.
    """
    added = [c for c in right.columns if c not in (*keys, date)]
    if set(added) & set(left.columns) or f"next_{date}" in left.columns:
        raise ValueError("the tables share names besides their keys and the date")
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, date)])
    rows = left.select(*keys, date, F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(F.col(date).alias(f"next_{date}"), *added)).schema[0].dataType).alias("_right"))
    marks = right.filter(usable).select(*keys, date, F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.struct(F.col(date).alias(f"next_{date}"), *added).alias("_right"))
    # Backwards, a row meets the marks that came before it; on the same day those are first that may be met.
    mark_first = F.col("_left").isNotNull() if not strict else F.col("_left").isNull()
    back = Window.partitionBy(*keys).orderBy(F.col(date).desc(), mark_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(marks).withColumn("_met", F.when(usable, F.last("_right", ignorenulls=True).over(back)))
    return met.filter("_left is not null").select("_left.*", "_met.*")


def _account(g: pd.DataFrame, cash: float) -> tuple[pd.DataFrame, list[tuple[object, object, float]]]:
    """Equity of one code's rows, and its trades (entry, exit, return)."""
    shares, entry, equity, held, trades = 0, None, [], [], []
    before = g["signal"].shift(1).fillna(0)
    for date, o, c, s in zip(g["date"], g["open"], g["close"], before, strict=True):
        if s > 0 and not shares and o > 0:
            shares = int(cash // o)
            cash, entry = cash - shares * o, (date, o) if shares else None
        elif s < 0 and shares:
            cash += shares * o
            trades.append((entry[0], date, o / entry[1] - 1))
            shares = 0
        equity.append(cash + shares * c)
        held.append(shares)
    if shares:
        trades.append((entry[0], g["date"].iat[-1], g["close"].iat[-1] / entry[1] - 1))
    return g.assign(equity=equity, shares=held), trades


def account(signals: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Adds equity and shares of an account for each code.

    It acts on the signal of the row before at the open: buys what whole shares it can if it holds none, sells
    all on -1; equity is marked at the close.
    """
    return per_code(signals, lambda g: _account(g, cash)[0], "equity double, shares long")


_STATS = "total double, annual double, max_drawdown double, sharpe double, n_trades long, win double, pl_ratio double, mean_ret double"


def _account_stats(g: pd.DataFrame, cash: float) -> dict[str, float]:
    out, trades = _account(g, cash)
    e = out["equity"].to_numpy()
    r = np.diff(e) / e[:-1]
    r = np.concatenate(([0.0], r))  # the first row earned nothing
    wins, losses = [t[2] for t in trades if t[2] > 0], [t[2] for t in trades if t[2] < 0]
    days = (pd.Timestamp(g["date"].iat[-1]) - pd.Timestamp(g["date"].iat[0])).days
    total = e[-1] / cash - 1
    spread = r.std(ddof=1) if len(r) > 1 else 0.0
    return {
        "total": total, "annual": total * 365 / days if days else np.nan, "max_drawdown": float((e / np.maximum.accumulate(e) - 1).min()), "sharpe": float(r.mean() / spread * np.sqrt(252)) if spread > 0 else 0.0,
        "n_trades": len(trades), "win": len(wins) / len(trades) if trades else np.nan, "pl_ratio": np.mean(wins) / abs(np.mean(losses)) if wins and losses else np.nan, "mean_ret": np.mean([t[2] for t in trades]) if trades else np.nan,
    }


def account_stats(signals: DataFrame, cash: float = 1_000_000.0, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """A row for each key: total, annual (total over calendar years), max_drawdown, sharpe (of all rows, the first
    with a return of 0; 0 without deviation), n_trades, win share, pl_ratio (null without gains or losses), mean_ret."""
    kinds = ", ".join(f"{k} {dict(signals.dtypes)[k]}" for k in keys)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date", ignore_index=True)
        return pd.DataFrame([{k: g[k].iat[0] for k in keys} | _account_stats(g, cash)])

    return grouped_apply(signals, list(keys), run, f"{kinds}, {_STATS}")


def grid_search(index: DataFrame, panel: DataFrame, pos_nums: list[int], neg_nums: list[int], cash: float = 1_000_000.0, window: int = 20, **thresholds) -> DataFrame:
    """Account statistics for every pair of counts, and best (of the code's highest total, the first of equal ones): one job for the whole grid.

    Movers are counted once; only a row a date is spread over the grid.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("pos_num"), F.lit(n).alias("neg_num")) for p, n in product(pos_nums, neg_nums)])
    # Index rows are spread, too, so that a date without an effect stays in every pair's account.
    x = index.withColumn("ma", rolling("close", window, grid=False)).join(movers(panel, **thresholds), "date", "left").withColumn("g", F.explode(grid)).select("*", "g.*")
    effect = _effect(F.col("pos_num"), F.col("neg_num"))
    x = x.withColumn("signal", F.when(effect == -1, -1).when((effect == 1) & (F.col("close") > F.col("ma")), 1).otherwise(0))
    stats = account_stats(x.select("code", "pos_num", "neg_num", "date", "open", "close", "signal"), cash, ("code", "pos_num", "neg_num"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("total"), "pos_num", "neg_num"))
    return stats.withColumn("best", place == 1)
