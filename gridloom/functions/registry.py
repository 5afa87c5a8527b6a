"""Factors by name, built-in and a user's own: a callable from bars to rows of date, code, factor_name and fac.

The built-in ones are registered by ``gridloom.operators.intraday``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

FACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def factor(name: str) -> Callable:
    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FACTORS[name] = fn
        return fn

    return add


def compute(bars: DataFrame, names: list[str] | None = None, clear: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of the named factors (all: None), passed through ``clear`` if given."""
    out = reduce(DataFrame.unionByName, [FACTORS[n](bars).select("date", "code", "factor_name", "fac") for n in names or FACTORS])
    return clear(out) if clear else out


def grouped_apply(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """The single door to grouped Python: ``fn`` gets one key's rows as pandas."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
