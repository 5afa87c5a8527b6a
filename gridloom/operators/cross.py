"""Operators on each date's cross-section of a long panel (date, code, fac)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.columns import average_rank, pair_corr, ratio
from gridloom.operators.selection import group_quantiles, quantile_columns


def date_window() -> WindowSpec:
    return Window.partitionBy("date")


def z_of(x: Column, over: WindowSpec | None = None) -> Column:
    """(x - mean) / sample deviation; null where the deviation is 0 or unknown."""
    over = over or date_window()
    return ratio(x - F.avg(x).over(over), F.stddev_samp(x).over(over))


def zscore(panel: DataFrame, col: str = "fac", all_pos: bool = False) -> DataFrame:
    """z-scores per date, lifted to a least value of 0 with ``all_pos``."""
    out = panel.withColumn(col, z_of(F.col(col)))
    return out.withColumn(col, F.col(col) - F.min(col).over(date_window())) if all_pos else out


def _with_mad(panel: DataFrame, col: str, n: float) -> DataFrame:
    """Adds _med, _mad, _lo and _hi.  Medians are counted out for all dates at once and joined: no date is one task's state."""
    with_med = panel.join(quantile_columns(panel, {"_med": (col, 0.5)}, ["date"]), "date", "left")
    gap = F.abs(F.col(col) - F.col("_med"))
    with_mad = with_med.join(quantile_columns(with_med, {"_mad": (gap, 0.5)}, ["date"]), "date", "left")
    return with_mad.withColumns({"_lo": F.col("_med") - n * F.col("_mad"), "_hi": F.col("_med") + n * F.col("_mad")})


def clip_mad(panel: DataFrame, n: float = 5.0, how: str = "replace", col: str = "fac") -> DataFrame:
    """Values further than n median deviations from the median: moved to the bound (``replace``; zeros stay
    zeros), made null (``null``), or spread in order over the next half deviation (``trend``)."""
    out, x = _with_mad(panel, col, n), F.col(col)
    if how == "replace":
        new = F.least(F.greatest(x, F.col("_lo")), F.col("_hi")) * F.abs(F.signum(x))
        new = F.when(x.isNotNull(), new)
    elif how == "null":
        new = F.when(x.between(F.col("_lo"), F.col("_hi")), x)
    elif how == "trend":
        side = F.when(F.col("_mad") == 0, 0).when(x <= F.col("_lo"), -1).when(x >= F.col("_hi"), 1).otherwise(0)
        out = out.withColumn("_side", side)
        tail = Window.partitionBy("date", "_side")
        i, m = F.row_number().over(tail.orderBy(col, "code")), F.count(F.lit(1)).over(tail)
        place = ratio(i - 1, m - 1)
        half = 0.5 * F.col("_mad")
        low = F.col("_lo") - half + half * F.coalesce(place, F.lit(1.0))
        high = F.col("_hi") + half * F.coalesce(place, F.lit(1.0))
        new = F.when(F.col("_side") == -1, low).when(F.col("_side") == 1, high).otherwise(x)
    else:
        raise ValueError("how is replace, null or trend")
    return out.withColumn(col, new).drop("_med", "_mad", "_lo", "_hi", "_side")


def clip_sigma(panel: DataFrame, n: float = 3.0, col: str = "fac") -> DataFrame:
    """Null outside mean +- n sample deviations."""
    x = F.col(col)
    mean, dev = F.avg(x).over(date_window()), F.stddev_samp(x).over(date_window())
    return panel.withColumn(col, F.when(x.between(mean - n * dev, mean + n * dev), x))


def clip_percentile(panel: DataFrame, low: float = 0.025, high: float = 0.975, col: str = "fac") -> DataFrame:
    """Null outside two quantiles."""
    bounds = quantile_columns(panel, {"_lo": (col, low), "_hi": (col, high)}, ["date"])
    return panel.join(bounds, "date", "left").withColumn(col, F.when(F.col(col).between(F.col("_lo"), F.col("_hi")), F.col(col))).drop("_lo", "_hi")


def clip(panel: DataFrame, method: str, parameter: float | tuple[float, float] | None = None, col: str = "fac") -> DataFrame:
    """mad (5.0), three_sigma (3.0) or percentile ((0.025, 0.975)), with its default or a parameter of its type."""
    kind = {"mad": float, "three_sigma": float, "percentile": tuple}.get(method)
    if kind is None or parameter is not None and not isinstance(parameter, kind):
        raise ValueError("mad and three_sigma take a float, percentile a tuple")
    if method == "percentile":
        return clip_percentile(panel, *(parameter or (0.025, 0.975)), col=col)
    default = 5.0 if method == "mad" else 3.0
    n = default if parameter is None else parameter
    return clip_mad(panel, n, col=col) if method == "mad" else clip_sigma(panel, n, col)


def quantile_group(panel: DataFrame, groups: int = 10, col: str = "fac", out: str = "label") -> DataFrame:
    """Quantile bin from 0: edges are the date's distinct quantiles, bins are closed on the right, the first on both sides."""
    edges = group_quantiles(panel, col, [i / groups for i in range(groups + 1)], ["date"], "_edges").withColumn("_edges", F.array_distinct("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(col)))
    return panel.join(edges, "date", "left").withColumn(out, F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_edges")


def distance(panel: DataFrame, quantile: float | None = None, square: bool = False, col: str = "fac") -> DataFrame:
    """Distance of each value from its date's mean or quantile."""
    centre = panel.groupBy("date").agg(F.avg(col).alias("_c")) if quantile is None else quantile_columns(panel, {"_c": (col, quantile)}, ["date"])
    gap = F.col(col) - F.col("_c")
    return panel.join(centre, "date", "left").withColumn(col, gap * gap if square else F.abs(gap)).drop("_c")


def coin_reverse(panel: DataFrame, ret: str, vol: str, *, mean: bool = True, split: bool = False, out: str = "fac") -> DataFrame:
    """``ret`` with the sign of ``vol`` against its date's mean or median.

    With ``split`` the threshold is taken apart for positive and negative returns, where returns of the other
    side count as 0, and results of 0 become null.
    """

    def centres(**of: Column) -> DataFrame:
        if mean:
            return panel.groupBy("date").agg(*[F.avg(x).alias(n) for n, x in of.items()])
        return quantile_columns(panel, {n: (x, 0.5) for n, x in of.items()}, ["date"])

    r, v = F.col(ret), F.col(vol)
    if not split:
        return panel.join(centres(_c=v), "date", "left").withColumn(out, r * F.signum(v - F.col("_c"))).drop("_c")
    up, down = F.when(r >= 0, F.when(r == 0, 0.0).otherwise(v)), F.when(r <= 0, F.when(r == 0, 0.0).otherwise(v))
    signed = r * F.signum(v - F.when(r > 0, F.col("_up")).otherwise(F.col("_down")))
    return panel.join(centres(_up=up, _down=down), "date", "left").withColumn(out, F.nullif(signed, F.lit(0.0))).drop("_up", "_down")


def add_zscores(panel: DataFrame, cols: list[str], out: str = "fac") -> DataFrame:
    """Sum of the factors' z-scores, null if any is."""
    return panel.withColumn(out, reduce(lambda a, b: a + b, [z_of(F.col(c)) for c in cols]))


def residual(y: Column, x: Column, over: WindowSpec | None = None) -> Column:
    """y less its least-squares line on x over the rows that have both; null where either is."""
    over = over or date_window()
    both = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(both, y), F.when(both, x)
    slope = ratio(F.covar_samp(yy, xx).over(over), F.var_samp(xx).over(over))
    return (yy - F.avg(yy).over(over)) - slope * (xx - F.avg(xx).over(over))


def neutralise_size(panel: DataFrame, size: str = "circ_mv", col: str = "fac") -> DataFrame:
    return panel.withColumn(col, residual(F.col(col), F.col(size)))


def neutralise_industry(panel: DataFrame, industry: str = "industry", col: str = "fac") -> DataFrame:
    """Less the industry's mean: the residual of a regression on industry dummies and a constant."""
    return panel.withColumn(col, F.col(col) - F.avg(col).over(Window.partitionBy("date", industry)))


def neutralise(panel: DataFrame, *, size: bool = True, industry: bool = True, col: str = "fac") -> DataFrame:
    panel = neutralise_size(panel, col=col) if size else panel
    return neutralise_industry(panel, col=col) if industry else panel


def preprocess(panel: DataFrame, col: str = "fac") -> DataFrame:
    """Clips at three median deviations, takes size and industry out, and standardises; null rows go first."""
    return zscore(neutralise(clip_mad(panel.filter(F.col(col).isNotNull()), 3.0, col=col), col=col), col)


def regress_out(panel: DataFrame, y: str, xs: list[str], out: str = "fac") -> DataFrame:
    """Residual of y on several factors per date, fitted on complete rows; null where one is missing.

    A date's means and centred moments are grouped in Spark, where parts are merged without loss; only a k by k system
    per date is solved in Python.  Factors that depend on others share their weight.
    """
    if len(xs) == 1:
        return panel.withColumn(out, residual(F.col(y), F.col(xs[0])))
    whole = panel.dropna(subset=[y, *xs])
    k = len(xs)
    moments = whole.groupBy("date").agg(
        F.array(*[F.avg(c) for c in (*xs, y)]).alias("_means"), F.array(*[F.covar_pop(a, b) for a in xs for b in xs]).alias("_cov"), F.array(*[F.covar_pop(a, y) for a in xs]).alias("_with")
    )

    @F.pandas_udf("array<double>")
    def solve(cov: pd.Series, with_y: pd.Series) -> pd.Series:
        def one(c, v):
            # In units of the factors' deviations: the system is a correlation matrix.
            c, v = np.reshape(np.asarray(c, dtype=float), (k, k)), np.asarray(v, dtype=float)
            unit = np.sqrt(np.diag(c))
            unit[unit == 0] = 1.0
            return (np.linalg.lstsq(c / np.outer(unit, unit), v / unit, rcond=1e-12)[0] / unit).tolist()

        return pd.Series([one(c, v) for c, v in zip(cov, with_y, strict=True)], dtype=object)

    fit = moments.select("date", "_means", solve("_cov", "_with").alias("_beta"))
    gap = lambda c, i: F.col(c) - F.get("_means", F.lit(i))
    line = reduce(lambda a, b: a + b, [F.get("_beta", F.lit(i)) * gap(c, i) for i, c in enumerate(xs)])
    return panel.join(fit, "date", "left").withColumn(out, gap(y, k) - line).drop("_beta", "_means")


def orthogonalise(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Symmetric orthogonalisation of the factors' z-scores per date: F U D^-1/2 U'.

    Covariances are grouped in Spark, a k by k matrix per date is decomposed in Python.  A date with a singular
    matrix, and rows that lack a factor, are null.
    """
    z = panel.withColumns({c: z_of(F.col(c)) for c in cols})
    k = len(cols)
    pairs = [F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]

    @F.pandas_udf("array<double>")
    def root(row: pd.Series) -> pd.Series:
        def one(x):
            m = np.reshape(np.array(x, dtype=float), (k, k))
            if not np.isfinite(m).all():
                return None
            d, u = np.linalg.eigh((m + m.T) / 2)
            return None if d.min() <= 1e-12 else ((u / np.sqrt(d)) @ u.T).ravel().tolist()

        return pd.Series([one(x) for x in row], dtype=object)

    cov = z.groupBy("date").agg(*pairs)
    cov = cov.select("date", root(F.array(*[F.col(c) for c in cov.columns[1:]])).alias("_m"))
    turned = {c: reduce(lambda a, b: a + b, [F.col(d) * F.get("_m", F.lit(i * k + j)) for i, d in enumerate(cols)]) for j, c in enumerate(cols)}
    return z.join(cov, "date").withColumns(turned).drop("_m")


#: Candidates of a round of Box-Cox's search, and rounds: each leaves a sixteenth of the range, from -5 to 5.
LAMBDAS, LAMBDA_ROUNDS = 32, 7


def box_cox_lambdas(panel: DataFrame, col: str = "fac") -> DataFrame:
    """date, lambda (likeliest, from -5 to 5, to some 1e-8) and the values' mean logarithm, all dates at once.

    With values over their geometric mean the likeliest lambda is that of the least variance.  A round takes the variance of
    each date at evenly spaced candidates, in one aggregation; the next one looks between the neighbours of the least.  Dates with
    a negative value or fewer than two different positive ones have no row.
    """
    x = F.nullif(F.col(col).cast("double"), F.lit(0.0))
    dates = panel.groupBy("date").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(F.when(x > 0, F.ln(F.when(x > 0, x)))).alias("centre"))
    # Every round reads the same shuffle of dates and values, dealt by both, so that the input is computed once.
    values = panel.select("date", x.alias("x")).filter("x is not null").repartition("date", F.pmod(F.xxhash64("x"), F.lit(64)))
    at = dates.filter("least > 0 and least < most").select("date", "centre", F.lit(-5.0).alias("low"), F.lit(5.0).alias("high"))
    for _ in range(LAMBDA_ROUNDS):
        step = (F.col("high") - F.col("low")) / LAMBDAS
        near = values.join(at, "date").select("date", "centre", "low", "high", (F.ln("x") - F.col("centre")).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(LAMBDAS))).alias("i"))
        power = F.col("low") + F.col("i") * step
        near = near.withColumn("f", F.when(F.abs(power) < 1e-9, F.col("z")).otherwise(F.expm1(power * F.col("z")) / F.when(F.abs(power) < 1e-9, 1.0).otherwise(power)))
        spread = near.groupBy("date", "centre", "low", "high", "i").agg(F.var_pop("f").alias("spread"))
        best = spread.groupBy("date", "centre", "low", "high").agg(F.min(F.struct("spread", "i")).alias("best"))
        i = F.col("best.i")
        at = best.select("date", "centre", (F.col("low") + F.greatest(i - 1, F.lit(0)) * step).alias("low"), (F.col("low") + F.least(i + 1, F.lit(LAMBDAS)) * step).alias("high"))
    return at.select("date", ((F.col("low") + F.col("high")) / 2).alias("lambda"), "centre")


def box_cox(panel: DataFrame, col: str = "fac") -> DataFrame:
    """Box-Cox transform with each date's likeliest lambda; zeros become null, a date with a negative value, or without two different ones, is null."""
    best, x = F.col("_lambda"), F.nullif(F.col(col).cast("double"), F.lit(0.0))
    found = box_cox_lambdas(panel, col).select("date", F.col("lambda").alias("_lambda"))
    log = F.ln(F.when(x > 0, x))
    new = F.when(F.abs(best) < 1e-9, log).otherwise(F.expm1(best * log) / F.nullif(best, F.lit(0.0)))
    return panel.join(found, "date", "left").withColumn(col, F.when(best.isNotNull(), new)).drop("_lambda")


def correlation(panel: DataFrame, a: str, b: str, *, key: str = "date", method: str = "pearson") -> DataFrame:
    """Correlation of two columns for each ``key`` (date: across codes, code: along time)."""
    both = panel.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if method == "pearson":
        return both.groupBy(key).agg(pair_corr(a, b).alias("corr"))
    if method == "spearman":
        ranked = both.select(key, average_rank(F.col(a), [key]).alias("a"), average_rank(F.col(b), [key]).alias("b"))
        return ranked.groupBy(key).agg(pair_corr("a", "b").alias("corr"))
    if method != "kendall":
        raise ValueError("method is pearson, spearman or kendall")
    return kendall(both.select(key, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), key)


#: Rows of a part of a date's order, and the most parts.
PART_ROWS, MOST_PARTS = 8192, 64


def inversions(values: np.ndarray) -> int:
    """Pairs that stand in falling order, by merging sorted runs of doubling length."""
    if len(values) < 2:
        return 0
    ranks = np.unique(values, return_inverse=True)[1]
    top = int(ranks.max()) + 1
    runs = np.full(1 << (len(ranks) - 1).bit_length(), top - 1, dtype=np.int64)  # what fills up the last run is in order
    runs[: len(ranks)] = ranks
    runs, total = runs.reshape(-1, 1), 0
    while len(runs) > 1:
        left, right = runs[0::2], runs[1::2]
        width, apart = left.shape[1], np.arange(len(left))[:, None] * top
        upto = np.searchsorted((left + apart).ravel(), (right + apart).ravel(), side="right") - np.repeat(np.arange(len(left)) * width, width)
        total += int((width - upto).sum())
        runs = np.sort(np.concatenate((left, right), axis=1), axis=1)
    return total


def kendall(pairs: DataFrame, key: str) -> DataFrame:
    """key, corr: Kendall's tau-b of columns a and b for each key; null where one of them is constant.

    All pairs less the ties, which are counts, less twice the pairs in opposite order.  Those are counted by parts of either
    order: values between two approximate quantiles are a part, and so is each of these quantiles itself, so that a
    frequent value is a part that needs no look.  Pairs within a part of a, or of b, are counted by merges in
    a task; pairs of two different parts of both by the parts' counts, at most (2 * ``MOST_PARTS`` - 1)**2 of a key.
    """
    cuts = [F.lit(i / MOST_PARTS) for i in range(1, MOST_PARTS)]
    size = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, F.array(*cuts)).alias(f"cuts_{c}") for c in "ab"])
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / PART_ROWS)).cast("int")
    # Of the cuts as many, evenly, as there are parts less one.
    kept = lambda c: F.array_distinct(F.filter(f"cuts_{c}", lambda x, i: F.floor((i + 1) * F.col("parts") / MOST_PARTS) > F.floor(i * F.col("parts") / MOST_PARTS)))
    size = size.withColumn("parts", parts).select(F.col(key), "n", *[kept(c).alias(f"cuts_{c}") for c in "ab"])
    part = lambda c: (2 * F.size(F.filter(f"cuts_{c}", lambda x: x < F.col(c))) + F.array_contains(f"cuts_{c}", F.col(c)).cast("int")).alias(f"part_{c}")
    placed = pairs.join(size, key).select(key, "a", "b", part("a"), part("b"), (F.size("cuts_a") + F.size("cuts_b") > 0).alias("many"))

    within_a = placed.filter("part_a % 2 = 0").select(key, F.lit("a").alias("of"), F.col("part_a").alias("part"), "a", "b")
    within_b = placed.filter("many and part_b % 2 = 0").select(key, F.lit("b").alias("of"), F.col("part_b").alias("part"), F.col("part_a").cast("double").alias("a"), "b")
    kind = dict(pairs.dtypes)[key]

    def opposite(g: pd.DataFrame) -> pd.DataFrame:
        b = g["b"].to_numpy()
        return pd.DataFrame({key: g[key].iloc[:1], "opposite": [inversions(b[np.lexsort((b, g["a"].to_numpy()))])]})

    def across(g: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2 * MOST_PARTS, 2 * MOST_PARTS), dtype=object)
        counts[g["part_a"], g["part_b"]] = g["rows"].astype(object)
        below = np.cumsum(counts[:-1, ::-1], axis=0)  # rows of lower parts of a, by parts of b from the highest on
        higher = np.cumsum(below, axis=1)[:, ::-1]
        return pd.DataFrame({key: g[key].iloc[:1], "opposite": [int((counts[1:, :-1] * higher[:, 1:]).sum())]})

    merged = within_a.unionByName(within_b).groupBy(key, "of", "part").applyInPandas(opposite, f"`{key}` {kind}, opposite long")
    cells = placed.filter("many").groupBy(key, "part_a", "part_b").agg(F.count(F.lit(1)).alias("rows"))
    counted = merged.unionByName(cells.groupBy(key).applyInPandas(across, f"`{key}` {kind}, opposite long")).groupBy(key).agg(F.sum("opposite").alias("opposite"))
    # Ties of a, of b, and of both: counts of (a, b) first, so a frequent value is few rows in the others.
    twos = lambda c: F.sum(c * (c - 1) / 2)
    both = pairs.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("c"))
    tie = lambda c, out: both.groupBy(key, c).agg(F.sum("c").alias("c")).groupBy(key).agg(twos(F.col("c")).alias(out))
    tied = both.groupBy(key).agg(twos(F.col("c")).alias("ties_ab")).join(tie("a", "ties_a"), key).join(tie("b", "ties_b"), key)
    x = size.select(key, (F.col("n") * (F.col("n") - 1) / 2).alias("all")).join(tied, key).join(counted, key, "left")
    score = F.col("all") - F.col("ties_a") - F.col("ties_b") + F.col("ties_ab") - 2 * F.coalesce("opposite", F.lit(0))
    return x.select(key, ratio(score, F.sqrt(F.col("all") - F.col("ties_a")) * F.sqrt(F.col("all") - F.col("ties_b"))).alias("corr"))


def correlation_matrix(panel: DataFrame, cols: list[str], *, key: str = "date") -> DataFrame:
    """left, right, corr: the mean over keys of every pair's correlation, both ways round, in one aggregation."""
    pairs = list(combinations(cols, 2))
    each = panel.groupBy(key).agg(*[pair_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    mean = each.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(pairs))])
    rows = [F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), v.alias("corr")) for i, (a, b) in enumerate(pairs) for x, y, v in ((a, b, F.col(f"c{i}")), (b, a, F.col(f"c{i}")))]
    rows += [F.struct(F.lit(c).alias("left"), F.lit(c).alias("right"), F.lit(1.0).alias("corr")) for c in cols]
    return mean.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def merge_factors(long: DataFrame, names: list[str], how: str = "outer") -> DataFrame:
    """date, code and a column for each factor_name: one shuffle for any number of factors."""
    wide = long.groupBy("date", "code").agg(*[F.max(F.when(F.col("factor_name") == n, F.col("fac"))).alias(n) for n in names])
    return wide if how == "outer" else wide.dropna(subset=names)


def zip_factors(wide: DataFrame, cols: list[str], out: str = "cells") -> DataFrame:
    return wide.select("date", "code", F.array(*cols).alias(out))


def factors_std(wide: DataFrame, cols: list[str], weights: list[float] | None = None, out: str = "fac") -> DataFrame:
    """Population deviation across the factors of a row, null if one is missing; weights leave the mean unweighted."""
    mean = reduce(lambda a, b: a + b, map(F.col, cols)) / len(cols)
    w = weights or [1.0] * len(cols)
    total = reduce(lambda a, b: a + b, [x * (F.col(c) - mean) ** 2 for c, x in zip(cols, w, strict=True)])
    return wide.withColumn(out, F.sqrt(total / sum(w)))


def weighted_std(panel: DataFrame, col: str, weight: str, key: str = "date", out: str = "fac") -> DataFrame:
    """key, out: sqrt(sum(w (x - mean)^2) / sum(w)) of each group; the mean is unweighted, rows without a value or weight don't count."""
    both = panel.filter(F.col(col).isNotNull() & F.col(weight).isNotNull())
    gap = F.col(col) - F.avg(col).over(Window.partitionBy(key))
    return both.select(key, F.col(weight).alias("_w"), gap.alias("_gap")).groupBy(key).agg(F.sqrt(ratio(F.sum(F.col("_w") * F.col("_gap") * F.col("_gap")), F.sum("_w"))).alias(out))


def coalesce_panels(panels: list[DataFrame], col: str = "fac") -> DataFrame:
    """Disjoint panels as one; of several values of a cell the first panel's counts."""
    tagged = [p.select("date", "code", F.col(col).alias("x"), F.lit(i).alias("i")) for i, p in enumerate(panels)]
    return reduce(DataFrame.unionByName, tagged).groupBy("date", "code").agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("i"))).alias(col))


def common_keys(panels: list[DataFrame], key: str) -> list[DataFrame]:
    """Panels restricted to the dates or codes that all have."""
    keys = reduce(lambda a, b: a.intersect(b), [p.select(key) for p in panels])
    return [p.join(keys, key, "left_semi") for p in panels]


def has_missing(dense: DataFrame, col: str = "fac") -> DataFrame:
    return dense.agg(F.coalesce(F.bool_or(F.col(col).isNull()), F.lit(False)).alias("missing"))


def grid_has_missing(panel: DataFrame, col: str = "fac") -> DataFrame:
    """``has_missing`` of all dates by all codes, without laying them out: whether a value is null or a cell lacks its row (one row a cell at most)."""
    whole = F.countDistinct("date") * F.countDistinct("code")
    return panel.agg((F.coalesce(F.bool_or(F.col(col).isNull()), F.lit(False)) | (F.count(F.lit(1)) < whole)).alias("missing"))


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that repeat ``keys`` the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def over_factors(long: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any operator of this module on many factors at once: factor_name joins the date as the key."""
    keyed = long.withColumn("date", F.struct("date", "factor_name")).drop("factor_name")
    return fn(keyed).withColumn("factor_name", F.col("date.factor_name")).withColumn("date", F.col("date.date"))


# Tradability


def main_boards(panel: DataFrame) -> DataFrame:
    return panel.filter(F.substring("code", 1, 1).isin("0", "3", "6"))


def without_new(panel: DataFrame, listing: DataFrame, days: int = 365, per_date: bool = False) -> DataFrame:
    """Drops codes listed less than ``days`` before the panel's last date, or before each row's date with ``per_date``."""
    if per_date:
        return panel.join(listing.select("code", "list_date"), "code", "left").filter(F.col("list_date").isNull() | (F.date_add("list_date", days) <= F.col("date"))).drop("list_date")
    last = panel.agg(F.max("date").alias("last"))
    new = listing.join(last, F.date_add("list_date", days) > F.col("last")).select("code")
    return panel.join(new, "code", "left_anti")


def mask_status(panel: DataFrame, status: DataFrame, name: str = "status", col: str = "fac") -> DataFrame:
    """Null where the joined status is 0; rows without a status stay."""
    flags = status.select("date", "code", F.col(name).alias("_flag"))
    return panel.join(flags, ["date", "code"], "left").withColumn(col, F.when(F.coalesce(F.col("_flag"), F.lit(1)) != 0, F.col(col))).drop("_flag")


def tradable(panel: DataFrame, *, listing: DataFrame, st: DataFrame, suspended: DataFrame, limits: DataFrame, days: int = 365, smooth_days: int = 0, col: str = "fac") -> DataFrame:
    """New listings out, then special treatment, suspension and price limits masked; smoothed if asked for."""
    from gridloom.operators.series import smooth

    out = without_new(panel, listing, days)
    for table, name in ((st, "status"), (suspended, "status"), (limits, "limit_status")):
        out = mask_status(out, table, name, col)
    return smooth(out, smooth_days, col) if smooth_days else out


def expand_membership(spells: DataFrame, until: str | None = None) -> DataFrame:
    """code, kind, date: one row for each day from a kind's first entry to its last exit (open: ``until`` or today)."""
    end = F.current_date() if until is None else F.to_date(F.lit(until))
    span = spells.groupBy("code", "kind").agg(F.min("entry").alias("a"), F.max(F.coalesce("exit", end)).alias("b")).filter("a <= b")
    return span.select("code", "kind", F.explode(F.sequence("a", "b")).alias("date"))
