"""Scans along a key's rows as compositions of maps: what a row does to the state before it is a map, and maps compose.

Composition is associative, so a prefix needs no loop over rows: the rows of a block (a run of dates) are composed in
four steps of ``lag``, each over four times as many rows; the blocks' own maps, one a block, are folded in a list
that the calendar bounds; and each row is its block's start and its own prefix.  A key's rows are spread over as many
tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A map's columns by name.
Map = dict[str, Column]
#: How many rows a step composes.
FAN = 4
#: Days of a block: its rows, one a day at most, are composed in four steps.
BLOCK_STEPS = 4
BLOCK_DAYS = FAN**BLOCK_STEPS


def day_block(date: str = "date") -> Column:
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / BLOCK_DAYS)


def _before(name: str, rows: int, unit: Column | None, order: WindowSpec) -> Column:
    """The column ``rows`` rows before; a row that isn't there changes nothing."""
    lagged = F.lag(name, rows).over(order)
    return lagged if unit is None else F.coalesce(lagged, unit)


def _prefixes(df: DataFrame, names: list[str], unit: dict[str, Column | None], compose: Callable[[Map, Map], Map], order: WindowSpec, steps: int) -> DataFrame:
    """Each row's map composed with all maps before it in its window's partition, which has at most FAN**steps rows."""
    others = [c for c in df.columns if c not in names]
    for step in range(steps):
        # The window's results become columns first: composed in place they would stand in it many times.
        flat = df.select("*", *[_before(n, j * FAN**step, unit[n], order).alias(f"{n}_{j}") for j in range(1, FAN) for n in names])
        maps = [{n: F.col(f"{n}_{j}") for n in names} for j in range(FAN - 1, 0, -1)] + [{n: F.col(n) for n in names}]
        # From the earliest on, so that each map stands in it once.
        df = flat.select(*others, *[c.alias(n) for n, c in reduce(lambda done, later: compose(later, done), maps).items()])
    return df


def compose_prefixes(df: DataFrame, maps: Map, unit: dict[str, Column | None], compose: Callable[[Map, Map], Map], *, keys: tuple[str, ...] = ("code",), order: str = "date", firsts: Map | None = None) -> DataFrame:
    """Adds columns of each row's map composed with those of all rows of its key before it.

    ``compose(later, earlier)`` gives the columns of the later map after the earlier one; ``unit`` is the map that changes nothing.
    ``order`` is a date that a key has once.  ``firsts`` adds columns of structs (``order``, value): the key's first value that isn't null.
    """
    names, firsts = list(maps), firsts or {}
    x = df.withColumns({**maps, **{n: F.when(c.isNotNull(), F.struct(order, c.alias("value"))) for n, c in firsts.items()}, "_block": day_block(order)})
    inner = _prefixes(x, names, unit, compose, Window.partitionBy(*keys, "_block").orderBy(order), BLOCK_STEPS)
    # A block's own map is folded from its list of rows, 256 at most: only maps are read for it, and no windows.
    kinds = {f.name: f.dataType for f in x.schema.fields}
    nothing = F.struct(*[(F.lit(None).cast(kinds[n]) if unit[n] is None else unit[n].cast(kinds[n])).alias(n) for n in names])
    after = lambda done, m: F.struct(*[c.cast(kinds[n]).alias(n) for n, c in compose({n: m[n] for n in names}, {n: done[n] for n in names}).items()])
    rows = F.array_sort(F.collect_list(F.struct(order, *names)))
    whole = x.groupBy(*keys, "_block").agg(rows.alias("_rows"), *[F.min(n).alias(n) for n in firsts]).withColumn("_m", F.aggregate("_rows", nothing, after))
    # A key has some hundred blocks in a century, and 14,300 in all the dates that there are.
    listed = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_blocks"), *[F.min(n).alias(f"_first_{n}") for n in firsts])
    each = listed.select("*", F.posexplode(F.transform("_blocks", lambda m: m["_block"])).alias("_at", "_block"))
    start = each.select(*keys, "_block", *[f"_first_{n}" for n in firsts], F.aggregate(F.slice("_blocks", F.lit(1), F.col("_at")), nothing, lambda done, b: after(done, b["_m"])).alias("_start"))
    out = compose({n: F.col(n) for n in names}, {n: F.col(f"_start.{n}") for n in names})
    return inner.drop(*firsts).join(start, [*keys, "_block"]).select(*df.columns, *[c.alias(n) for n, c in out.items()], *[F.col(f"_first_{n}").alias(n) for n in firsts])


def affine_scan(df: DataFrame, steps: dict[str, tuple[Column, Column, Column]], *, keys: tuple[str, ...] = ("code",), order: str = "date") -> DataFrame:
    """Adds a column for each of ``steps``: the value of x -> a x + b run along a key's rows.

    A step is (a, b, seed).  The value before a key's first row is its first ``seed`` that isn't null; rows before that one have no
    value.  A null ``a`` or ``b`` leaves the value as it is.
    """
    maps: Map = {}
    for name, (a, b, _) in steps.items():
        moves = a.isNotNull() & b.isNotNull()
        maps |= {f"_a_{name}": F.when(moves, a).otherwise(1.0), f"_b_{name}": F.when(moves, b).otherwise(0.0)}

    def compose(later: Map, earlier: Map) -> Map:
        out = {}
        for name in steps:
            (la, lb), (ea, eb) = ([m[f"_{p}_{name}"] for p in "ab"] for m in (later, earlier))
            out |= {f"_a_{name}": la * ea, f"_b_{name}": la * eb + lb}
        return out

    unit: dict[str, Column | None] = {n: F.lit(1.0 if n.startswith("_a_") else 0.0) for n in maps}
    x = compose_prefixes(df.drop(*steps), maps, unit, compose, keys=keys, order=order, firsts={f"_s_{n}": seed.cast("double") for n, (_, _, seed) in steps.items()})
    value = lambda n: F.when(F.col(order) >= F.col(f"_s_{n}.{order}"), F.col(f"_a_{n}") * F.col(f"_s_{n}.value") + F.col(f"_b_{n}"))
    return x.select(*[c for c in df.columns if c not in steps], *[value(n).alias(n) for n in steps])


def ema_steps(x: Column, span: int) -> tuple[Column, Column, Column]:
    """Steps of the exponential mean, which is the first value at first; a null leaves it as it is."""
    alpha = 2 / (span + 1)
    return F.when(x.isNotNull(), F.lit(1 - alpha)), alpha * x, x


def state_scan(df: DataFrame, images: dict[int, Column], start: int, out: str = "signal", *, keys: tuple[str, ...] = ("code",), order: str = "date") -> DataFrame:
    """Adds ``out``: the state of a machine along a key's rows; ``images`` is where a row takes each state, ``start`` the state before the first row."""
    # A map is an array: at each state's place the place of where it goes.
    states = list(images)
    place = lambda image: reduce(lambda rest, i: F.when(image == states[i], i).otherwise(rest), range(len(states)), F.lit(None).cast("int"))
    compose = lambda later, earlier: {"_map": F.transform(earlier["_map"], lambda s: F.get(later["_map"], s))}
    done = compose_prefixes(df.drop(out), {"_map": F.array(*[place(c) for c in images.values()])}, {"_map": F.array(*[F.lit(i) for i in range(len(states))])}, compose, keys=keys, order=order)
    return done.withColumn(out, F.get(F.array(*[F.lit(s) for s in states]), F.get("_map", F.lit(states.index(start))))).drop("_map")
