"""Factor evaluation: rank information coefficients, equal-count groups, long-short returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import average_rank, corrected_skewness, pair_corr, ratio
from gridloom.operators.returns import before
from gridloom.operators.series import on_grid, shifted
from gridloom.sources.readers import between, resample

#: Periods a year and trading days a period of each frequency.
FREQUENCIES = {"D": (252, 1), "W": (52, 5), "M": (12, 22)}


def per_year(freq: str) -> int:
    """Periods a year of D, W or M."""
    if freq not in FREQUENCIES:
        raise ValueError(f"freq is one of {', '.join(FREQUENCIES)}")
    return FREQUENCIES[freq][0]


def period_returns(prices: DataFrame, col: str = "open") -> DataFrame:
    """date, code, ret: the price against the grid period before; prices of 0 are missing."""
    x = on_grid(prices.select("date", "code", F.nullif(F.col(col), F.lit(0.0)).alias("p")))
    return x.select("date", "code", (ratio(F.col("p"), shifted("p")) - 1).alias("ret")).filter("ret is not null")


def paired(factor: DataFrame, rets: DataFrame, lag: int = 1) -> DataFrame:
    """date, code, ret and the factor of ``lag`` periods before.

    1 pairs a return with the value at the end of the period before; 2 leaves a period between them.
    """
    x = on_grid(factor).withColumn("fac", shifted("fac", lag)).filter("fac is not null").select("date", "code", "fac")
    return rets.join(x, ["date", "code"])


def rank_ic(pairs: DataFrame) -> DataFrame:
    """date, ic (Spearman), ic_low and ic_high (over the halves up to and from the median, ranked anew)."""
    med = pairs.groupBy("date").agg(F.percentile("fac", F.lit(0.5)).alias("med"))
    x = pairs.join(med, "date").withColumns({"low": F.col("fac") <= F.col("med"), "high": F.col("fac") >= F.col("med")})
    x = x.withColumns({"rf": average_rank(F.col("fac"), ["date"]), "rr": average_rank(F.col("ret"), ["date"])})
    # A half is a run of the factor's order, so its own factor ranks are the whole's but for a constant; its ranks
    # of the return count its rows in the return's order.  So two sorts serve all six rankings.
    order = Window.partitionBy("date").orderBy(F.col("ret").asc_nulls_last())
    upto = lambda half: F.count_if(F.col(half)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = lambda half: F.count_if(F.col(half)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    x = x.withColumns({f"r_{half}": F.when(F.col(half), upto(half) - (ties(half) - 1) / 2.0) for half in ("low", "high")})
    f = lambda half: F.when(F.col(half), F.col("rf"))
    return x.groupBy("date").agg(pair_corr("rf", "rr").alias("ic"), pair_corr(f("low"), "r_low").alias("ic_low"), pair_corr(f("high"), "r_high").alias("ic_high"))


def ic_summary(ic: DataFrame, per_year: int = 52) -> DataFrame:
    """Means of the three series, and the mean over the deviation, a year."""
    return ic.agg(F.avg("ic").alias("ic"), F.avg("ic_low").alias("ic_low"), F.avg("ic_high").alias("ic_high"), (ratio(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.lit(per_year))).alias("icir"))


def equal_groups(pairs: DataFrame, groups: int = 10) -> DataFrame:
    """Adds grp, 1 to ``groups`` by rising factor, of round(n / groups) codes each (half to even); what is over joins the last."""
    w = Window.partitionBy("date")
    each = F.bround(F.count(F.lit(1)).over(w) / groups).cast("long")
    place = F.row_number().over(w.orderBy("fac", "code"))
    label = F.when(each == 0, F.lit(groups)).otherwise(F.least(F.lit(groups), F.floor((place - 1) / F.nullif(each, F.lit(0))) + 1))
    return pairs.withColumn("grp", label.cast("int"))


def group_returns(grouped: DataFrame) -> DataFrame:
    """date, grp, ret: mean return of each group."""
    return grouped.groupBy("date", "grp").agg(F.avg("ret").alias("ret"))


def group_net_values(grouped: DataFrame, freq: str = "W") -> DataFrame:
    """date, grp, ret, net: each group's mean returns and their sums, with a row of 0 a period before the first date."""
    each = group_returns(grouped)
    first = each.agg(F.min("date").alias("first"))
    zero = each.select("grp").distinct().join(first).select(before(F.col("first"), freq).alias("date"), "grp", F.lit(0.0).alias("ret"))
    run = Window.partitionBy("grp").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return each.unionByName(zero).withColumn("net", F.sum("ret").over(run))


def against_index(ls: DataFrame, index: DataFrame) -> DataFrame:
    """Adds index_ret, long_minus_index and net_index: the long leg of ``long_short`` against an index (date, ret); a date without one is null."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date: small
    x = ls.join(index.select("date", F.col("ret").alias("index_ret")), "date", "left").withColumn("long_minus_index", F.col("long") - F.col("index_ret"))
    return x.withColumn("net_index", F.sum("long_minus_index").over(run))


def long_short(grouped: DataFrame, groups: int = 10) -> DataFrame:
    """date, long, short, market, ls, inner_long, inner_short, net and net_long.

    The legs are groups 1 and ``groups``, turned round if the first's summed lead is not above 0.
    """
    legs = grouped.groupBy("date").agg(F.avg(F.when(F.col("grp") == 1, F.col("ret"))).alias("first"), F.avg(F.when(F.col("grp") == groups, F.col("ret"))).alias("last"), F.avg("ret").alias("market"))
    way = legs.agg(F.when(F.sum(F.col("first") - F.col("last")) > 0, 1).otherwise(-1).alias("way"))
    x = legs.join(way).withColumns({"long": F.when(F.col("way") > 0, F.col("first")).otherwise(F.col("last")), "short": F.when(F.col("way") > 0, F.col("last")).otherwise(F.col("first"))})
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date: small
    x = x.withColumns({"ls": F.col("long") - F.col("short"), "inner_long": F.col("long") - F.col("market"), "inner_short": F.col("market") - F.col("short")})
    return x.withColumns({"net": F.sum("ls").over(run), "net_long": F.sum("inner_long").over(run)}).select("date", "long", "short", "market", "ls", "inner_long", "inner_short", "net", "net_long")


def long_short_stats(ls: DataFrame, per_year: int = 52) -> DataFrame:
    """annual_ret, vol, ir of the long-short series, inner_long and inner_short (a year).

    Net values begin with a row of 0, which counts as a period in the yearly returns; the deviation is of the series alone.
    """
    n = F.count(F.lit(1)) + 1
    vol = F.stddev_pop("ls") * F.sqrt(F.lit(per_year))
    annual = F.max_by("net", "date") * per_year / n
    inner = lambda c: (F.sum(c) * per_year / n).alias(c)
    return ls.agg(annual.alias("annual_ret"), vol.alias("vol"), ratio(annual, vol).alias("ir"), inner("inner_long"), inner("inner_short"))


def group_summary(grouped: DataFrame, per_year: int = 52) -> DataFrame:
    """grp, excess: mean return of each group over the market, a year."""
    market = grouped.agg(F.avg("ret").alias("m"))
    return grouped.groupBy("grp").agg(F.avg("ret").alias("r")).join(market).select("grp", ((F.col("r") - F.col("m")) * per_year).alias("excess"))


def long_side_by_year(grouped: DataFrame, groups: int = 10, per_year: int = 52) -> DataFrame:
    """year, ret: mean return a year of whichever of groups 1 and ``groups`` has the higher mean."""
    each = group_returns(grouped)
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("ret")))
    side = each.agg(F.when(mean(1) > mean(groups), 1).otherwise(groups).alias("grp"))
    return each.join(side, "grp").groupBy(F.year("date").alias("year")).agg((F.avg("ret") * per_year).alias("ret"))


def coverage(factor: DataFrame, prices: DataFrame, col: str = "open") -> DataFrame:
    """coverage, positive, skew and autocorr of a factor; dates on which it has no value don't count.

    coverage is all its values over all prices (but 0) of its dates, 1 at most, and positive the share of all its signs; skew and
    autocorr (with the factor's date before) are means over dates.  A value needs no price.
    """
    known = factor.filter(F.col("fac").isNotNull())
    x = on_grid(known).withColumn("before", shifted("fac"))
    each = x.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fac") > 0).alias("up"), F.count_if(F.col("fac") < 0).alias("down"), corrected_skewness(F.col("fac")).alias("sk"), pair_corr("fac", "before").alias("ac"))
    priced = prices.groupBy("date").agg(F.count(F.nullif(F.col(col), F.lit(0.0))).alias("priced"))
    return each.join(priced, "date", "left").agg(
        F.least(F.lit(1.0), ratio(F.sum("n"), F.sum("priced"))).alias("coverage"), ratio(F.sum("up"), F.sum("up") + F.sum("down")).alias("positive"), F.avg("sk").alias("skew"), F.avg("ac").alias("autocorr")
    )


#: The rows of ``factor_summary``, in order.
SUMMARY = ("ic", "annual_ret", "vol", "ir", "positive", "skew", "autocorr", "coverage", "ic_low", "ic_high", "first_excess", "last_excess")


def factor_summary(factor: DataFrame, prices: DataFrame, groups: int = 10, freq: str = "W", lag: int = 1, index: DataFrame | None = None) -> DataFrame:
    """metric, value: the twelve figures of a factor named in ``SUMMARY``.

    The first and last group's excess is over an index (date, ret) on the factor's dates, or over the mean of all codes.
    """
    n = per_year(freq)
    pairs = paired(factor, period_returns(prices), lag)
    grouped = equal_groups(pairs, groups)
    ic, cover = ic_summary(rank_ic(pairs), n), coverage(factor, prices)
    stats = long_short_stats(long_short(grouped, groups), n)
    each = group_returns(grouped)
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("ret")))
    market = (grouped.groupBy("date").agg(F.avg("ret").alias("m")) if index is None else factor.filter("fac is not null").select("date").distinct().join(index.select("date", F.col("ret").alias("m")), "date")).agg(F.avg("m").alias("m"))
    ends = each.agg(mean(1).alias("f"), mean(groups).alias("l")).join(market).select(((F.col("f") - F.col("m")) * n).alias("first_excess"), ((F.col("l") - F.col("m")) * n).alias("last_excess"))
    row = ic.join(stats).join(cover).join(ends)  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in SUMMARY])).alias("x")).select("x.*")


def summaries(factors: dict[str, DataFrame], prices: DataFrame, **kw) -> DataFrame:
    """factor_name, metric, value of several factors."""
    return reduce(DataFrame.unionByName, [factor_summary(f, prices, **kw).select(F.lit(name).alias("factor_name"), "metric", "value") for name, f in factors.items()])


def at_frequency(factor: DataFrame, prices: DataFrame, freq: str, start: str | None = None, end: str | None = None, col: str = "open") -> tuple[DataFrame, DataFrame]:
    """A daily factor between two dates, its last value of each period, and each period's first open (last of any other price)."""
    per_year(freq)
    return resample(between(factor, "date", start, end).select("date", "code", "fac"), "fac", freq), resample(prices.select("date", "code", col), col, freq, "first" if col == "open" else "last")


def evaluate(factor: DataFrame, prices: DataFrame, groups: int = 10, lag: int = 1, freq: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The long-short series of a factor, from prices to net values; one plan, no action.

    With ``freq`` factor and prices are daily: they are resampled before the factor is lagged by a period.
    """
    if freq is not None:
        factor, prices = at_frequency(factor, prices, freq, start, end)
    else:
        factor = between(factor, "date", start, end)
    return long_short(equal_groups(paired(factor, period_returns(prices), lag), groups), groups)
