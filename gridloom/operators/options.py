"""Closed-form option greeks and position rules on a book of options.

A book row has opt_id, book, cp (C or P), s, k, t_years, r, sigma, q, contracts, multiplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import normal_cdf, normal_density, ratio


def greeks(book: DataFrame) -> DataFrame:
    """Adds d1, d2, delta, gamma, vega and theta (a year), with a dividend yield; null where t or sigma is 0."""
    s, k, t, r, v, q = (F.col(c) for c in ("s", "k", "t_years", "r", "sigma", "q"))
    root = v * F.sqrt(t)
    x = book.withColumn("d1", ratio(F.ln(s / k) + (r - q + v * v / 2) * t, root)).withColumn("d2", F.col("d1") - root)
    call = F.col("cp") == "C"
    dq, dr = F.exp(-q * t), F.exp(-r * t)
    n1, n2, phi = normal_cdf(F.col("d1")), normal_cdf(F.col("d2")), normal_density(F.col("d1"))
    decay = -s * dq * phi * ratio(v, 2 * F.sqrt(t))
    theta_call = decay - r * k * dr * n2 + q * s * dq * n1
    theta_put = decay + r * k * dr * (1 - n2) - q * s * dq * (1 - n1)
    return x.withColumns({"delta": F.when(call, dq * n1).otherwise(dq * (n1 - 1)), "gamma": ratio(dq * phi, s * root), "vega": s * dq * F.sqrt(t) * phi, "theta": F.when(call, theta_call).otherwise(theta_put)})


def value_change(delta: Column, gamma: Column, vega: Column, theta: Column, ds: Column, dv: Column, dt: Column) -> Column:
    """Second-order change of value: delta dS + gamma dS^2 / 2 + vega dsigma + theta dt."""
    return delta * ds + 0.5 * gamma * ds * ds + vega * dv + theta * dt


def share_equivalents(x: DataFrame, key: str = "book") -> DataFrame:
    """key, sep (delta * contracts * multiplier), delta, gamma, vega, theta of the positions."""
    held = lambda c: F.sum(F.col(c) * F.col("contracts"))
    return x.groupBy(key).agg(F.sum(F.col("delta") * F.col("contracts") * F.col("multiplier")).alias("sep"), *[held(c).alias(c) for c in ("delta", "gamma", "vega", "theta")])


def delta_after(delta: Column, gamma: Column, ds: Column) -> Column:
    return delta + gamma * ds


def calendar_spread(near: DataFrame, far: DataFrame, key: str, most_iv: float = 0.4, enter: float = 1.0, leave: float = 0.5) -> DataFrame:
    """key, net_theta, net_vega, twr (theta ratio - 1), enter and leave of short near and long far options."""
    n = near.select(key, F.col("theta").alias("tn"), F.col("vega").alias("vn"), F.col("sigma").alias("iv"))
    f = far.select(key, F.col("theta").alias("tf"), F.col("vega").alias("vf"))
    twr = F.abs(ratio(F.col("tn"), F.col("tf"))) - 1
    return n.join(f, key).select(key, (F.col("tf") - F.col("tn")).alias("net_theta"), (F.col("vf") - F.col("vn")).alias("net_vega"), twr.alias("twr"), ((twr >= enter) & (F.col("iv") <= most_iv)).alias("enter"), (twr < leave).alias("leave"))


def intrinsic_value(cp: Column, s: Column, k: Column) -> Column:
    return F.greatest(F.when(cp == "C", s - k).otherwise(k - s), F.lit(0.0))


def time_value(price: Column, cp: Column, s: Column, k: Column) -> Column:
    return price - intrinsic_value(cp, s, k)


def max_contracts(budget: Column, margin: Column) -> Column:
    return F.floor(ratio(budget, margin))


def theta_return(theta_daily: Column, margin: Column) -> Column:
    """Annualised: theta a day * 252 / margin."""
    return ratio(theta_daily * 252, margin)


def theta_covers_gamma(theta: Column, gamma: Column, sigma: Column, s: Column) -> Column:
    """Whether |gamma| is at most theta / (sigma^2 s^2 / 2)."""
    return F.abs(gamma) <= ratio(theta, 0.5 * sigma * sigma * s * s)


def vega_days(vega: Column, theta: Column) -> Column:
    return ratio(vega, F.abs(theta))


def risk_flags(books: DataFrame, nav: float, target: float = 0.0, band: float = 0.05, hedge_at: float = 5000.0, most_share: float = 0.2, most_gamma: float = 0.05) -> DataFrame:
    """Adds rebalance (off the target by more than the band), hedge, delta_over (share of NAV), gamma_over and gamma_theta."""
    off = F.abs(F.col("sep") - target) > band * F.greatest(F.abs(F.lit(target)), F.lit(1.0))
    return books.withColumns({"rebalance": off, "hedge": F.abs("sep") > hedge_at, "delta_over": F.abs("sep") > most_share * nav, "gamma_over": F.abs("gamma") > most_gamma, "gamma_theta": ratio(F.col("gamma"), F.col("theta"))})


def sell_screen(x: DataFrame, most_ratio: float = 5.0) -> DataFrame:
    """Options that may be sold: |gamma| below twice |theta| and gamma / theta at most ``most_ratio``."""
    return x.filter((F.abs("gamma") < 2 * F.abs("theta")) & (ratio(F.col("gamma"), F.col("theta")) <= most_ratio))


def atm_concentration(x: DataFrame, width: float = 0.01, key: str = "book") -> DataFrame:
    """key, share of gamma within ``width`` of the strike, and whether it is 30 % or more."""
    near = F.abs(F.col("s") / F.col("k") - 1) <= width
    size = F.abs(F.col("gamma") * F.col("contracts"))
    out = x.groupBy(key).agg(ratio(F.coalesce(F.sum(F.when(near, size)), F.lit(0.0)), F.sum(size)).alias("share"))
    return out.withColumn("over", F.col("share") >= 0.3)


def close_at_expiry(x: DataFrame, at: str | None = None, width: float = 0.01) -> DataFrame:
    """Adds close: whether a position ends on day ``at`` (its own date, if there is none) with the price within ``width`` of the strike; null without a strike, price or expiry."""
    today = F.col("date") if at is None else F.to_date(F.lit(at))
    return x.withColumn("close", (F.col("expiry") == today) & (F.abs(F.col("s") - F.col("k")) <= width * F.abs("k")))


def hedge_trades(path: DataFrame) -> DataFrame:
    """Adds trade, -(gamma * change of the price) of each step of an option's path (opt_id, date, s, gamma)."""
    w = Window.partitionBy("opt_id").orderBy("date")
    return path.withColumn("trade", -F.lag("gamma").over(w) * (F.col("s") - F.lag("s").over(w)))


def strategy_greeks(legs: DataFrame) -> DataFrame:
    """strategy and the signed sums of its legs' greeks (side 1 bought, -1 sold, with quantity)."""
    signed = lambda c: F.sum(F.col(c) * F.col("side") * F.col("quantity")).alias(c)
    return legs.groupBy("strategy").agg(*[signed(c) for c in ("delta", "gamma", "vega", "theta")])


def in_base_currency(deltas: DataFrame, rates: DataFrame) -> DataFrame:
    return deltas.join(rates, "currency").groupBy("book").agg(F.sum(F.col("sep") * F.col("rate")).alias("sep"))
