"""Daily factors from intraday bars (code, date, seq, close, high, low, volume)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.columns import float_ratio, ratio
from gridloom.functions.registry import factor, grouped_apply
from gridloom.operators.selection import coarse, fine
from gridloom.operators.series import code_rows, on_grid, rolling_days, shifted
from gridloom.sources.kept import settled, steps

_HOW = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "first": lambda c: F.min_by(c, "seq"), "last": lambda c: F.max_by(c, "seq")}


def day_window() -> WindowSpec:
    return Window.partitionBy("code", "date")


def day_bars() -> WindowSpec:
    return day_window().orderBy("seq")


def to_freq(bars: DataFrame, freq: str, how: str, col: str) -> DataFrame:
    """code, date, bucket and ``col`` of every k bars by position ('5T'); a partial last bucket stays, a day of fewer than k bars is null."""
    if not freq.endswith("T") or not freq[:-1].isdigit() or how not in _HOW:
        raise ValueError("freq is like 5T, how one of " + ", ".join(_HOW))
    k = int(freq[:-1])
    x = bars.withColumns({"bucket": F.floor((F.row_number().over(day_bars()) - 1) / k), "_n": F.count(F.lit(1)).over(day_window())})
    return x.groupBy("code", "date", "bucket").agg(F.when(F.max("_n") >= k, _HOW[how](col)).alias(col))


def with_returns(bars: DataFrame, within_day: bool = False) -> DataFrame:
    """Adds ret against the code's bar before, across days unless ``within_day``.

    Bars are ordered by date, then seq.  They are dealt by code and day; a day's first bar gets the last close of the
    code's day before from a table of a row a day, so that no task holds a code's whole history of bars.
    """
    lag = F.lag("close").over(day_bars())
    if within_day:
        return bars.withColumn("ret", ratio(F.col("close"), lag) - 1)
    last = bars.groupBy("code", "date").agg(F.max_by("close", "seq").alias("_last"))
    last = last.select("code", "date", F.lag("_last").over(code_rows()).alias("_before"))
    before = F.when(F.row_number().over(day_bars()) == 1, F.col("_before")).otherwise(lag)
    return bars.join(last, ["code", "date"]).withColumn("ret", ratio(F.col("close"), before) - 1).drop("_before")


def returned(bars: DataFrame) -> DataFrame:
    """The bars that have a return: all daily factors are of these."""
    return with_returns(bars).filter("ret is not null")


def return_factors(bars: DataFrame) -> DataFrame:
    """rtn5_mean (of sums of five bars; null on a day with fewer), real_var, rtn_skew, rtn_kurt, rv_up, rv_down and rv_umd of each day's bar returns."""
    r = F.col("ret")
    sq = r * r
    x = returned(bars)
    five = to_freq(x, "5T", "sum", "ret").groupBy("code", "date").agg(F.avg("ret").alias("rtn5_mean"))
    out = x.groupBy("code", "date").agg(F.sum(sq).alias("real_var"), F.skewness(r).alias("rtn_skew"), F.kurtosis(r).alias("rtn_kurt"), F.coalesce(F.sum(F.when(r > 0, sq)), F.lit(0.0)).alias("rv_up"), F.coalesce(F.sum(F.when(r < 0, sq)), F.lit(0.0)).alias("rv_down"))
    return out.join(five, ["code", "date"]).withColumn("rv_umd", ratio(F.col("rv_up") - F.col("rv_down"), F.col("real_var")))


def volume_factors(bars: DataFrame) -> DataFrame:
    """Skew of log volume, the shares of the sum of log volumes that lie beyond their 90 % and 10 % quantiles of the
    day, cumulated volume, and pvi, the sum of returns where volume is above the day's mean."""
    x = returned(bars).withColumn("lv", F.ln(F.col("volume") + 1e-6))
    cuts = x.groupBy("code", "date").agg(F.percentile("lv", F.lit(0.9)).alias("q9"), F.percentile("lv", F.lit(0.1)).alias("q1"), F.avg("volume").alias("mean"))
    x = x.join(cuts, ["code", "date"]).withColumn("cum", F.sum("volume").over(day_bars().rangeBetween(Window.unboundedPreceding, 0)))
    v, lv = F.col("volume"), F.col("lv")
    part = lambda cond: ratio(F.coalesce(F.sum(F.when(cond, lv)), F.lit(0.0)), F.sum(lv))
    return x.groupBy("code", "date").agg(
        F.skewness(lv).alias("vol_skew"), part(lv > F.col("q9")).alias("top_share"), part(lv < F.col("q1")).alias("low_share"),
        F.avg("cum").alias("cum_mean"), F.stddev_samp("cum").alias("cum_std"), F.coalesce(F.sum(F.when(v > F.col("mean"), F.col("ret"))), F.lit(0.0)).alias("pvi"),
    )


def bucket_factors(bars: DataFrame, k: int = 15) -> DataFrame:
    """ovr and cvr, the volume shares of the first and last k-bar bucket, and skew and kurtosis of the buckets' changes; null with one bucket."""
    b = to_freq(returned(bars), f"{k}T", "sum", "volume")
    w = day_window().orderBy("bucket")
    b = b.withColumns({"chg": ratio(F.col("volume"), F.lag("volume").over(w)) - 1, "n": F.count(F.lit(1)).over(day_window())})
    several = F.col("n") >= 2
    out = b.groupBy("code", "date", "n").agg(ratio(F.min_by("volume", "bucket"), F.sum("volume")).alias("ovr"), ratio(F.max_by("volume", "bucket"), F.sum("volume")).alias("cvr"), F.skewness("chg").alias("chg_skew"), F.kurtosis("chg").alias("chg_kurt"))
    return out.select("code", "date", *[F.when(several, F.col(c)).alias(c) for c in ("ovr", "cvr", "chg_skew", "chg_kurt")])


def volatility_factors(bars: DataFrame, k: int = 5, skip: int = 15, parkinson: str = "extremes") -> DataFrame:
    """vov1, the deviation of k-bar sums of returns without the day's first and last bars, and vov2, the
    range-based volatility of k-bar highs and lows (their means with ``parkinson='mean'``; null on a day of fewer bars).

    A low of 0 makes the day's vov2 infinite (NaN where the high is 0 too): such a range has no bound and isn't left out.
    """
    x = returned(bars).withColumns({"place": F.row_number().over(day_bars()), "n": F.count(F.lit(1)).over(day_window())})
    inner = x.filter((F.col("place") >= skip) & (F.col("place") <= F.col("n") - skip))
    one = to_freq(inner, f"{k}T", "sum", "ret").groupBy("code", "date").agg(F.stddev_samp("ret").alias("vov1"))
    high, low = ("mean", "mean") if parkinson == "mean" else ("max", "min")
    b = x.groupBy("code", "date", "n", F.floor((F.col("place") - 1) / k).alias("bucket")).agg(_HOW[high]("high").alias("high"), _HOW[low]("low").alias("low"))
    spread = F.ln(float_ratio(F.col("high"), F.col("low")))
    two = b.filter(F.col("n") >= k).groupBy("code", "date").agg(F.sqrt(F.sum(spread**2) / (4 * F.ln(F.lit(2.0)) * F.count(F.lit(1)))).alias("vov2"))
    return x.select("code", "date").distinct().join(two, ["code", "date"], "left").join(one, ["code", "date"], "left").select("code", "date", "vov1", "vov2")


def _scores(r: Column, v: Column) -> dict[str, Column]:
    """s1 |R| / sqrt V, s2 |R| / V^0.1, s3 V, s5 |R| / ln V, of |R| and V; |R| / 0 is infinite."""
    inf = F.lit(float("inf"))
    over = lambda d: F.when(d == 0, inf).otherwise(F.try_divide(r, d))
    return {"s1": over(F.sqrt(v)), "s2": over(F.pow(v, F.lit(0.1))), "s3": v, "s5": F.when(v == 0, F.lit(0.0)).otherwise(over(F.when(v > 0, F.ln(v))))}


def smart_scores(bars: DataFrame) -> DataFrame:
    """Adds price (typical) and the scores s1 to s5 but s4.

    Rows without a return, and those for which a score is 0 / 0, are dropped; |R| / 0 ranks first.
    """
    x = returned(bars).withColumn("price", (F.col("close") + F.col("high") + F.col("low")) / 3).withColumnRenamed("ret", "_r")
    x = x.filter(~((F.abs("_r") == 0) & ((F.col("volume") == 0) | (F.col("volume") == 1))))
    return x.withColumns(_scores(F.abs("_r"), F.col("volume").cast("double")))


#: Distinct values of a code's block of days that are ranked in one task without being cut into slices.
SLICE_ROWS = 1 << 17
_NAN = float("nan")


def _falling(r: Column, v: Column) -> dict[str, Column]:
    """The scores as numbers that rise along the order of bars: from the highest score down, missing ones (NaN) last."""
    return {k: F.coalesce(F.lit(0.0) - s, F.lit(_NAN)) for k, s in _scores(r, v).items()}


def _cell(x: Column) -> Column:
    """A whole number that never falls as x rises, some 176 for each power of two; NaN comes last."""
    digit = coarse(x)
    return (digit * 1024 + F.greatest(F.lit(-512), F.least(F.lit(511), F.floor(fine(x, digit) / 4096)))).cast("long")


def _smart_bars(bars: DataFrame) -> DataFrame:
    """The bars that have scores: _d, the day's number in the code, _days, the code's days, _a, |R|, _r, |R| against the bar
    before among these, _v, volume, _t, turnover, _first, whether it is its day's first.  NaN is the missing value."""
    x = smart_scores(bars).select("code", "date", "seq", "close", "price", F.col("volume").cast("double").alias("volume"), F.abs("_r").alias("_a"))
    last = x.groupBy("code", "date").agg(F.max_by("close", "seq").alias("_last"))
    days = last.select("code", "date", F.row_number().over(code_rows()).alias("_d"), F.lag("_last").over(code_rows()).alias("_before"), F.count(F.lit(1)).over(Window.partitionBy("code")).cast("int").alias("_days"))
    first = F.row_number().over(day_bars()) == 1
    before = F.when(first, F.col("_before")).otherwise(F.lag("close").over(day_bars()))
    known = lambda c, other: F.coalesce(F.nanvl(c, F.lit(other)), F.lit(other))
    return x.join(days, ["code", "date"]).select(
        "code", "date", "_d", "_days", "seq", known(F.col("_a"), _NAN).alias("_a"), known(F.abs(ratio(F.col("close"), before) - 1), _NAN).alias("_r"), known(F.col("volume"), _NAN).alias("_v"),
        known(F.col("price") * F.col("volume"), 0.0).alias("_t"), first.alias("_first"),
    )


def _lower_slices(g: pd.DataFrame) -> pd.DataFrame:
    """Of a code's block: for each slice and day what the slices below hold."""
    n, m = (g.pivot(index="_slice", columns="_d", values=c).sort_index().fillna(0).cumsum().shift(1, fill_value=0).astype("int64").stack() for c in ("_n", "_m"))
    out = pd.DataFrame({"_n": n, "_m": m}).reset_index()
    out = out[out["_n"] > 0]
    return out.assign(code=g["code"].iat[0], _block=g["_block"].iat[0], _days=g["_days"].iat[0], _x=-np.inf, _own=False)


def _slice_ranks(days: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each own value of a slice twice its mean rank in the windows that end on its day (_k0), a day later (_k1) and so on."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_x", ignore_index=True)
        x, d, n, m, own = (g[c].to_numpy() for c in ("_x", "_d", "_n", "_m", "_own"))
        out = np.zeros((len(g), days), dtype=np.int64)
        if own.any():
            for end in range(max(days, d[own].min()), min(g["_days"].iat[0], d[own].max() + days - 1) + 1):
                at = np.flatnonzero((d > end - days) & (d <= end))
                if not len(at):
                    continue
                upto = np.cumsum(n[at] - np.where(d[at] == end - days + 1, m[at], 0))
                new = np.concatenate(([True], x[at][1:] != x[at][:-1]))
                last = upto[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
                out[at, end - d[at]] = (np.concatenate(([0], last[:-1])) + last + 1)[np.cumsum(new) - 1]
        return pd.concat([g[["code", "_d", "_x"]], pd.DataFrame(out, columns=[f"_k{i}" for i in range(days)])], axis=1)[own]

    return run


def _window_ranks(pairs: DataFrame, value: str, days: int, block: int, first_counts: bool) -> DataFrame:
    """code, _d, _x and _k0 to _k(days - 1): twice the mean rank of each distinct value of a day in the windows that hold the
    day, by their ends.  The first bar of a window counts only with ``first_counts``.

    A code's days are dealt in blocks with the days around them, and the values of a block in slices of values next to each
    other; of the slices below, a slice gets a row a day.  So no task holds a window's bars, and equal values of a day are one row.
    """
    counts = pairs.groupBy("code", "_d", "_days", F.col(value).alias("_x")).agg(F.sum(F.when(F.isnan(value), 0).otherwise(F.col("_n"))).alias("_n"), F.sum(F.when(F.isnan(value) | ~F.col("_first") | first_counts, 0).otherwise(F.col("_n"))).alias("_m"))
    place = lambda c: F.floor(c / block)
    blocks = F.sequence(F.greatest(F.lit(0), place(F.col("_d") - days + 1)), F.least(place(F.col("_days")), place(F.col("_d") + days - 1)))
    spread = counts.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == place(F.col("_d")))
    # A row for each code and block.
    sizes = spread.groupBy("code", "_block").agg(F.count(F.lit(1)).alias("_size"))
    slices = F.when(F.col("_size") > 64 * SLICE_ROWS, _cell(F.col("_x"))).when(F.col("_size") > SLICE_ROWS, coarse(F.col("_x"))).otherwise(F.lit(0).cast("long"))
    spread = spread.join(F.broadcast(sizes), ["code", "_block"]).withColumn("_slice", slices).drop("_size")
    held = spread.groupBy("code", "_block", "_slice", "_d", "_days").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    kinds = dict(spread.dtypes)
    below = grouped_apply(held, ["code", "_block"], _lower_slices, ", ".join(f"{c} {kinds[c]}" for c in spread.columns))
    ranks = ", ".join(f"_k{i} long" for i in range(days))
    out = grouped_apply(spread.unionByName(below), ["code", "_block", "_slice"], _slice_ranks(days), f"code {kinds['code']}, _d int, _x double, {ranks}")
    return out.withColumn("_x", F.coalesce("_x", F.lit(_NAN)))  # pandas gives NaN back as null


_WINDOW = ("code", "_e", "score")
#: Volume and turnover before a window's cell, and of the whole window.
_CUT = ("_bw", "_bt", "_aw", "_at")


def _cut_cells(cells: DataFrame, order: list[str], share: float, *carried: str) -> DataFrame:
    """Of each window and score the cell where the running volume passes the share (the last one if it never does), with the volume
    and turnover before it (_bw, _bt; those of the cells come on top) and those of all (_aw, _at)."""
    before = Window.partitionBy(*_WINDOW).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = cells.withColumns({f"_b{c}": F.col(f"_b{c}") + F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)) for c in "wt"})
    x = x.filter(F.col("_bw") <= share * F.col("_aw"))
    found = x.groupBy(*_WINDOW).agg(F.max_by(F.struct(*order, *_CUT, *carried), F.struct(*order)).alias("_at_cut"))
    return found.select(*_WINDOW, "_at_cut.*")


def _ends(days: int) -> Column:
    """The numbers of the days on which the windows of a row's day end; null without one."""
    first, last = F.greatest(F.col("_d"), F.lit(days)), F.least(F.col("_d") + days - 1, F.col("_days"))
    return F.when(first <= last, F.sequence(first, last))


def _by_rank(pairs: DataFrame, r_ranks: DataFrame, v_ranks: DataFrame, days: int, wanted: DataFrame | None = None) -> DataFrame:
    """The pairs once for each of their windows, with s4 (_z, as in ``_falling``); with ``wanted`` its list too, by code and day."""
    other = v_ranks.select("code", "_d", F.col("_x").alias("_v"), *[F.col(f"_k{i}").alias(f"_u{i}") for i in range(days)])
    x = pairs.join(r_ranks.withColumnRenamed("_x", "_r"), ["code", "_d", "_r"])
    # What is wanted goes with the fewer rows.
    x = x.join(other if wanted is None else other.join(wanted, ["code", "_d"]), ["code", "_d", "_v"])
    lost = F.isnan("_r") | F.isnan("_v")
    z = [F.when(lost | F.col("_first") if i == days - 1 else lost, F.lit(_NAN)).otherwise(-(F.col(f"_k{i}") + F.col(f"_u{i}")).cast("double")) for i in range(days)]
    x = x.select(*pairs.columns, *([] if wanted is None else ["_wanted"]), F.posexplode(F.array(*z)).alias("_i", "_z")).withColumn("_e", F.col("_d") + F.col("_i"))
    return x.filter((F.col("_e") >= days) & (F.col("_e") <= F.col("_days"))).withColumn("score", F.lit("s4"))


def _hits(x: DataFrame, *same: str) -> DataFrame:
    """The rows once for each entry of _wanted that has the row's _c (and ``same``), with the window and what lies before its cell."""
    x = x.withColumn("_c", _cell(F.col("_z"))).filter(F.array_contains(F.col("_wanted._c"), F.col("_c")))
    fits = lambda w: reduce(lambda a, c: a & (w[c] == F.col(c)), same, w["_c"] == F.col("_c"))
    x = x.withColumn("_hit", F.explode(F.filter("_wanted", fits))).drop("_e", "_wanted", "_c")
    return x.select("code", "score", "_z", "_d", "date", "_w", "_t", F.when(F.col("score") == "s4", F.struct("_r", "_v", "_first")).alias("_pair"), F.col("_hit._e"), *[F.col(f"_hit.{c}") for c in _CUT])


def _lists(found: DataFrame, keys: list[str], names: dict[str, str], *what: str) -> DataFrame:
    """keys and for each score a list of what its windows want."""
    return found.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("score") == s, F.struct(*what, *_CUT))).alias(name) for s, name in names.items()])


def smart_money(bars: DataFrame, days: int = 10, share: float = 0.2, block: int = 40) -> DataFrame:
    """code, date (window end), score, q: price of the bars with the highest scores, up to ``share`` of the
    window's volume, against the whole window's price; for scores s1 to s5.

    s4 adds the ranks of |R| and V within the window, where R is against the window's own bar before: its first bar
    has none and comes last.  If the first bar alone exceeds the share, q is null.

    A window's bars are never in one task.  Bars of a day with equal |R| and V are one row (a pair); of pairs volume and turnover are
    summed by cells of the score and by windows, which tells each window's cell where the share is reached.  The pairs of those
    cells are summed by score and day, and of the score and day where the share is reached the bars are run through in their order.
    The ranks are counted in slices of values (blocks of ``block`` days).  The steps before the last are done when this is called.
    """
    rows = _smart_bars(bars)
    z, nothing = _falling(F.col("_a"), F.col("_v")), F.lit(0.0)
    with steps(bars.sparkSession) as write:
        pairs = write(rows.groupBy("code", "date", "_d", "_days", "_a", "_r", "_v", "_first").agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_t")), "pairs")
        pairs = pairs.withColumn("_w", F.nanvl("_v", nothing) * F.col("_n"))
        ranks = [write(_window_ranks(pairs, c, days, block, first_counts), f"ranks{c}") for c, first_counts in (("_r", False), ("_v", True))]
        sums = [F.sum(c).alias(c) for c in ("_w", "_t")]

        each = F.explode(F.array(*[F.struct(F.lit(k).alias("score"), c.alias("_z")) for k, c in z.items()]))
        by_day = pairs.select("code", "_d", "_days", "_w", "_t", each.alias("_s")).groupBy("code", "_d", "_days", "_s.score", _cell(F.col("_s._z")).alias("_c")).agg(*sums)
        cells = by_day.withColumn("_e", F.explode(_ends(days))).select(*_WINDOW, "_c", "_w", "_t")
        cells = cells.unionByName(_by_rank(pairs, *ranks, days).select(*_WINDOW, _cell(F.col("_z")).alias("_c"), "_w", "_t"))
        whole = Window.partitionBy(*_WINDOW)
        cells = cells.groupBy(*_WINDOW, "_c").agg(*sums).withColumns({"_aw": F.sum("_w").over(whole), "_at": F.sum("_t").over(whole), "_bw": nothing, "_bt": nothing})
        found = write(_cut_cells(cells, ["_c"], share), "cells")

        wanted = found.withColumn("_d", F.explode(F.sequence(F.col("_e") - days + 1, F.col("_e"))))
        lists = _lists(wanted, ["code", "_d"], {k: f"_wanted_{k}" for k in z}, "_e", "_c")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("score"), c.alias("_z"), F.col(f"_wanted_{k}").alias("_wanted")) for k, c in z.items()]))
        values = _hits(pairs.join(lists, ["code", "_d"]).select(*pairs.columns, each.alias("_s")).select(*pairs.columns, "_s.*"))
        values = values.unionByName(_hits(_by_rank(pairs, *ranks, days, _lists(wanted, ["code", "_d"], {"s4": "_wanted"}, "_e", "_c")), "_e"))
        values = values.groupBy(*_WINDOW, "_z", "_d", "date", *_CUT).agg(*sums, F.collect_list("_pair").alias("_pairs"))
        ends = pairs.select("code", F.col("_d").alias("_e"), F.col("date").alias("_end")).distinct()
        found = settled(_cut_cells(values, ["_z", "_d"], share, "date", "_pairs").join(ends, ["code", "_e"]))

    lists = _lists(found, ["code", "date"], {k: f"_wanted_{k}" for k in z}, "_end", "_z").join(_lists(found, ["code", "date"], {"s4": "_wanted_s4"}, "_end", "_pairs"), ["code", "date"])
    x = rows.join(lists, ["code", "date"]).withColumns({f"_{k}": c for k, c in z.items()}).withColumn("_pair", F.struct("_r", "_v", "_first"))
    x = x.filter(reduce(lambda a, b: a | b, [F.array_contains(F.col(f"_wanted_{k}._z"), F.col(f"_{k}")) for k in z], F.array_contains(F.flatten("_wanted_s4._pairs").getField("_r"), F.col("_r"))))
    same = lambda k: lambda w: w["_z"] == F.col(f"_{k}")
    named = lambda k: lambda w: F.struct(F.lit(k).alias("score"), w["_end"].alias("_end"), *[w[c].alias(c) for c in _CUT])
    fits = {k: same(k) for k in z} | {"s4": lambda w: F.array_contains(w["_pairs"], F.col("_pair"))}
    hit = [F.transform(F.filter(f"_wanted_{k}", fit), named(k)) for k, fit in fits.items()]
    x = x.select("code", "seq", F.nanvl("_v", nothing).alias("_w"), "_t", F.explode(F.concat(*hit)).alias("_hit")).select("code", "seq", "_w", "_t", "_hit.*")
    run = F.sum("_w").over(Window.partitionBy("code", "_end", "score").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_in", F.col("_bw") + run <= share * F.col("_aw"))
    x = x.filter("_in").groupBy("code", "_end", "score").agg(F.sum("_w").alias("_w"), F.sum("_t").alias("_t"))
    # Every window has a row: of none of its last cell's bars, where they are past the share.
    x = found.join(x, ["code", "_end", "score"], "left").fillna(0.0, ["_w", "_t"])
    q = ratio(ratio(F.col("_bt") + F.col("_t"), F.col("_bw") + F.col("_w")), ratio(F.col("_at"), F.col("_aw")))
    return x.select("code", F.col("_end").alias("date"), "score", q.alias("q"))


def reverse_momentum(bars: DataFrame, daily: DataFrame, days: int = 20, top: int = 10, quantile: float = 15 / 16) -> DataFrame:
    """code, date, m_high, m_low, m: sums of the daily return over the ``top`` days of highest and lowest quantile of
    the bars' mean price (amount / volume) among the last ``days`` days, and their difference.  Days without a quantile come last."""
    q = bars.groupBy("code", "date").agg(F.percentile(ratio(F.col("amount"), F.col("volume")), F.lit(quantile)).alias("q"))
    x = q.join(daily.select("code", "date", "ret"), ["code", "date"], "left")
    x = rolling_days(x, days)
    w = Window.partitionBy("code", "window_end")
    x = x.withColumns({"hi": F.row_number().over(w.orderBy(F.desc_nulls_last("q"), "date")), "lo": F.row_number().over(w.orderBy(F.asc_nulls_last("q"), "date"))})
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c) <= top, F.col("ret"))), F.lit(0.0))
    out = x.groupBy("code", F.col("window_end").alias("date")).agg(part("hi").alias("m_high"), part("lo").alias("m_low"))
    return out.withColumn("m", F.col("m_high") - F.col("m_low"))


def day_returns(bars: DataFrame) -> DataFrame:
    """code, date, ret of each day's last close against the grid day before."""
    days = on_grid(bars.groupBy("code", "date").agg(F.max_by("close", "seq").alias("close")))
    return days.select("code", "date", (ratio(F.col("close"), shifted("close")) - 1).alias("ret"))


def _long(wide: DataFrame, prefix: str = "") -> DataFrame:
    return union_factors([wide]).withColumn("factor_name", F.concat(F.lit(prefix), "factor_name"))


@factor("pv_returns")
def _pv_returns(bars: DataFrame) -> DataFrame:
    return _long(return_factors(bars))


@factor("pv_volume")
def _pv_volume(bars: DataFrame) -> DataFrame:
    return _long(volume_factors(bars))


@factor("pv_bars15")
def _pv_bars15(bars: DataFrame) -> DataFrame:
    return _long(bucket_factors(bars))


@factor("pv_vov")
def _pv_vov(bars: DataFrame) -> DataFrame:
    return _long(volatility_factors(bars))


@factor("smart_money")
def _smart(bars: DataFrame) -> DataFrame:
    return smart_money(bars).select("date", "code", F.concat(F.lit("smart_"), "score").alias("factor_name"), F.col("q").alias("fac"))


@factor("reverse_m")
def _reverse(bars: DataFrame) -> DataFrame:
    return _long(reverse_momentum(bars, day_returns(bars)), "reverse_")


def union_factors(parts: list[DataFrame]) -> DataFrame:
    """Wide daily factors as long rows: date, code, factor_name, fac."""
    long = [p.unpivot(["date", "code"], [c for c in p.columns if c not in ("date", "code")], "factor_name", "fac") for p in parts]
    return reduce(DataFrame.unionByName, long)
