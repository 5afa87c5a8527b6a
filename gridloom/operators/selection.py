"""Exact quantiles of groups of any size: order statistics are found by counting ever finer digits of the values.

Each round counts, for all groups at once, a digit of the values that still matter, and leaves those values that share the
digit of a wanted one.  What a task holds is counts of digits; a group is never brought to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keeps digits of positive values above 0: a double's logarithm is above -1075.
_ABOVE = 20_000


def coarse(x: Column) -> Column:
    """A whole number that never falls as x rises: sixteen steps for each power of two, on both sides of 0; NaN comes last."""
    step = F.floor(F.log2(F.least(F.abs(x), F.lit(1.7e308))) * 16) + _ABOVE
    return F.when(F.isnan(x), 2 * _ABOVE).when(x == 0, 0).when(x < 0, -step).otherwise(step).cast("long")


def fine(x: Column, digit: Column) -> Column:
    """Of values with the same ``coarse`` digit a number that never falls as x rises, some 2**16 different ones."""
    scale = F.pow(F.lit(2.0), 20 - (F.abs(digit) - _ABOVE) / 16)
    return F.floor(F.when(digit == 0, F.lit(0.0)).otherwise(x * scale))


def _places(n: Column, qs: list[float]) -> Column:
    """The places, from 0, of the values on both sides of each quantile of n values."""
    at = [(n - 1) * F.lit(float(q)) for q in qs]
    return F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))


def _hits(counts: DataFrame, group: list[str], digit: str, wants: Column | None, qs: list[float]) -> DataFrame:
    """Of counted digits those that hold a wanted place, with the places (r) and what is left of them (rest)."""
    along = Window.partitionBy(*group).orderBy(digit)
    x = counts.withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if wants is None:
        x = x.withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
        wants = F.transform(_places(F.col("_all"), qs), lambda r: F.struct(r.alias("r"), r.alias("rest")))
    inside = F.filter(wants, lambda w: (w["rest"] >= F.col("_before")) & (w["rest"] < F.col("_before") + F.col("_n")))
    x = x.withColumn("_wants", F.transform(inside, lambda w: F.struct(w["r"].alias("r"), (w["rest"] - F.col("_before")).alias("rest"))))
    return x.filter(F.size("_wants") > 0).drop("_n", "_before")


def group_quantiles(df: DataFrame, col: Column | str, qs: list[float], keys: list[str], out: str = "quantiles") -> DataFrame:
    """keys and ``out``: an array of the exact quantiles ``qs`` (interpolated linearly) of each group's non-null values, all groups at once.

    A group without values has no row.
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("a quantile lies between 0 and 1")
    value = F.col(col) if isinstance(col, str) else col
    # Every round reads the same shuffle of keys and values, dealt by both, so that the input is computed once.
    rows = df.select(*keys, value.cast("double").alias("_x")).filter("_x is not null").repartition(*keys, F.pmod(F.xxhash64("_x"), F.lit(64)))
    rows = rows.withColumn("_d0", coarse(F.col("_x")))
    rows = rows.withColumn("_d1", fine(F.col("_x"), F.col("_d0")))
    found = _hits(rows.groupBy(*keys, "_d0").agg(F.count(F.lit(1)).alias("_n")), keys, "_d0", None, qs)
    for known, digit in ((["_d0"], "_d1"), (["_d0", "_d1"], "_x")):  # the values themselves end it: copies are counted as one row
        wanted = found.select(*keys, *known, "_all", F.col("_wants").alias("_wanted"))
        counts = rows.join(wanted, [*keys, *known]).groupBy(*keys, *known, digit, "_all", "_wanted").agg(F.count(F.lit(1)).alias("_n"))
        found = _hits(counts, [*keys, *known], digit, F.col("_wanted"), qs)
    at = found.select(*keys, "_all", "_x", F.explode("_wants.r").alias("_r")).groupBy(*keys).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_at"))

    def quantile(q: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(float(q))
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return at.select(*keys, F.array(*[quantile(q) for q in qs]).alias(out))


def quantile_columns(df: DataFrame, names: dict[str, tuple[Column | str, float]], keys: list[str]) -> DataFrame:
    """keys and a column for each name: the exact quantile of a column.  Names of the same column are found in the same rounds; a group without values is null."""
    columns: dict[str, list[str]] = {}
    for name, (col, _) in names.items():
        columns.setdefault(str(col), []).append(name)
    parts = []
    for same in columns.values():
        found = group_quantiles(df, names[same[0]][0], [names[n][1] for n in same], keys, "_q")
        parts.append(found.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(same)]))
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)
