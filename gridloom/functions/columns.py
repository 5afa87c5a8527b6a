"""Column expressions that the operators share; every one keeps null as the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0 (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite where b is 0, NaN where a is too; null only where one of them is."""
    by_zero = F.when(a == 0, float("nan")).otherwise(F.signum(a.cast("double")) * float("inf"))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(ratio(a, b))


def steady(x: Column, places: int) -> Column:
    """Rounds half away from zero in binary arithmetic, as other engines do (``round`` looks at the decimal form)."""
    scale = float(10**places)
    # ``floor`` would give a long and saturate; the remainder stays a double.  Infinities and NaN pass.  Half isn't added
    # before the remainder is taken: from 2 ** 52 on the sum is rounded itself, and odd numbers would go up by one.
    moved = F.abs(x) * scale
    part = moved % 1.0
    return F.nanvl(F.signum(x) * (moved - part + F.when(part >= 0.5, 1.0).otherwise(0.0)) / scale, x.cast("double"))


def no_nan(x: Column) -> Column:
    """NaN and infinities as null; done once, on ingest."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def average_rank(value: Column, keys: list[str | Column]) -> Column:
    """Rank of the non-null values in each group, ties sharing their mean rank; null for null.  One sort: ties are the peers of its order."""
    order = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def pair_corr(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson's correlation over the rows that have both; null where one of them is constant (``corr`` would raise)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def corrected_skewness(x: Column) -> Column:
    """Aggregate: skewness with the small-sample correction; null for fewer than three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def normal_cdf(x: Column) -> Column:
    """The normal distribution by the public five-term approximation (error below 1e-7): Spark has no erf."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = normal_density(x) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def code_suffix(code: Column) -> Column:
    """Pads a code to six digits and adds its exchange; a longer or unknown one stays."""
    full = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    first = F.substring(full, 1, 1)
    return F.concat(full, F.when(first.isin("0", "3"), ".SZ").when(first == "6", ".SH").when(first == "8", ".BJ").otherwise(""))


def percent_text(x: Column) -> Column:
    """12.34% with banker's rounding; null stays null."""
    return F.concat(F.bround(x * 100, 2).cast("string"), F.lit("%"))


def list_item(cell: Column, n: int) -> Column:
    """The n-th element of a list cell, from 0, from the end if negative; null outside."""
    return F.get(cell, F.lit(n) if n >= 0 else F.size(cell) + n)


def list_cells(df: DataFrame, cell: str = "cells", out: str = "fac") -> DataFrame:
    """A row for each element of a list cell: the other columns, n (from 0) and ``out``."""
    others = [c for c in df.columns if c != cell]
    return df.select(*others, F.posexplode(cell).alias("n", out))


def half_life_weights(window: int, half_life: float) -> Column:
    """Array of ``window`` weights that sum to 1, halving every ``half_life`` places, the newest last and largest."""
    raw = [0.5 ** ((window - 1 - i) / half_life) for i in range(window)]
    return F.array(*[F.lit(x / sum(raw)) for x in raw])


def pair_max(a: Column, b: Column) -> Column:
    """The larger of two, null if either is."""
    return (a + b + F.abs(a - b)) / 2


def pair_min(a: Column, b: Column) -> Column:
    return (a + b - F.abs(a - b)) / 2


def pick_by_sign(judge: Column, above: Column, below: Column) -> Column:
    """``above`` where judge > 0, ``below`` where it is < 0, else 0; null if either side is."""
    out = F.when(judge > 0, above).when(judge < 0, below).otherwise(0.0)
    return F.when(above.isNotNull() & below.isNotNull(), out)


def pick_by_market(panel: DataFrame, judge: DataFrame, above: str, below: str, out: str = "fac") -> DataFrame:
    """``pick_by_sign`` by a market series (date, judge) that holds for all codes; a date without one counts as 0."""
    return panel.join(judge.select("date", F.col("judge").alias("_judge")), "date", "left").withColumn(out, pick_by_sign(F.col("_judge"), F.col(above), F.col(below))).drop("_judge")
