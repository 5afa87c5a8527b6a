"""Order statistics over a sliding window of days, in blocks of days that carry the days before them."""

from __future__ import annotations

from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.registry import grouped_apply


def with_halo(df: DataFrame, at: Column, size: int, halo: int) -> DataFrame:
    """Each row once for its own block of ``size`` places and for every later one whose rows look back on it (``halo`` places); adds _block and _own."""
    own = F.floor(at / size)
    return df.withColumn("_block", F.explode(F.sequence(own, F.floor((at + halo) / size)))).withColumn("_own", F.col("_block") == own)


class WindowRanks:
    """Counts of ranks in a window, in a tree of partial sums: a rank enters, leaves, and the k-th smallest is found in the logarithm of their number."""

    def __init__(self, ranks: int):
        self.top = 1 << max(0, ranks - 1).bit_length()
        self.tree = [0] * (self.top + 1)
        self.n = 0

    def add(self, rank: int, times: int = 1) -> None:
        self.n += times
        at = rank + 1
        while at <= self.top:
            self.tree[at] += times
            at += at & -at

    def kth(self, k: int) -> int:
        """The rank at place k, from 0."""
        at, step = 0, self.top
        while step:
            if at + step <= self.top and self.tree[at + step] <= k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return at


def sliding_quantiles(days: list[int], values: list[float | None], span: int, qs: list[float]) -> list[list[float | None]]:
    """For each row (rising days) the quantiles of the values of its day and the ``span`` - 1 days before; null without a value."""
    levels = sorted({v for v in values if v is not None})
    rank = {v: i for i, v in enumerate(levels)}
    seen, out, first, end = WindowRanks(len(levels)), [], 0, 0
    for i, day in enumerate(days):
        while end < len(days) and days[end] <= day:
            if values[end] is not None:
                seen.add(rank[values[end]])
            end += 1
        while days[first] <= day - span:
            if values[first] is not None:
                seen.add(rank[values[first]], -1)
            first += 1
        row: list[float | None] = []
        for q in qs:
            if not seen.n:
                row.append(None)
                continue
            place = q * (seen.n - 1)
            low, high = levels[seen.kth(floor(place))], levels[seen.kth(ceil(place))]
            row.append(low if low == high else low + (high - low) * (place - floor(place)))
        out.append(row)
    return out


def rolling_quantiles(df: DataFrame, col: str, quantiles: dict[str, float], days: int, *, key: str = "code", date: str = "date") -> DataFrame:
    """Adds exact quantiles of the values of the last ``days`` calendar days, the row's own included.

    A key's rows are dealt in blocks of four windows' days, each with the days before it, so a key is many tasks; a row
    costs the logarithm of its block's rows.  Null values don't count; a window without values is null.
    """
    names, qs = list(quantiles), list(quantiles.values())
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in names)
    base = df.drop(*names)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    spread = with_halo(base.withColumn("_day", day), F.col("_day"), 4 * days, days - 1)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_day", kind="stable", ignore_index=True)
        values = [None if pd.isna(v) else float(v) for v in g[col]]
        found = pd.DataFrame(sliding_quantiles(g["_day"].tolist(), values, days, qs), columns=names, dtype=float)
        return pd.concat([g, found], axis=1)[g["_own"].to_numpy()].drop(columns=["_day", "_block", "_own"])

    return grouped_apply(spread, [key, "_block"], run, kinds + "".join(f", `{n}` double" for n in names))
