"""Rolling order statistics, panes, inversion counts, as-of search and centred moments, against their definitions."""

import datetime as dt
import math
import os
import random
import uuid
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cross, intraday, rolling_order, timing

DAY = dt.date(2001, 1, 1)


def interpolated(values, q):
    s = sorted(values)
    at = q * (len(s) - 1)
    low, high = s[math.floor(at)], s[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


def test_ranks_enter_and_leave():
    r = random.Random(1)
    seen, held = rolling_order.WindowRanks(37), []
    for _ in range(500):
        if held and r.random() < 0.45:
            seen.add(held.pop(r.randrange(len(held))), -1)
        else:
            held.append(r.randrange(37))
            seen.add(held[-1])
        assert seen.n == len(held) and [seen.kth(k) for k in range(len(held))] == sorted(held)
    assert rolling_order.WindowRanks(1).top == 1


def test_rolling_quantiles_equal_sorting_each_window(spark):
    r = random.Random(2)
    rows = []
    for code in "ab":
        at = DAY
        for _ in range(300):
            rows += [(at, code, r.choice((None, 1.0, 2.0, r.gauss(0, 1))), "keep") for _ in range(r.choice((1, 1, 2)))]  # a day may have two rows
            at += dt.timedelta(r.choice((1, 1, 1, 5, 90)))
    df = spark.createDataFrame(rows, "date date, code string, x double, low string").repartition(5)
    out = rolling_order.rolling_quantiles(df, "x", {"q2": 0.2, "q9": 0.9}, 30).collect()
    key = lambda q: (q["code"], q["date"], -9.0 if q["x"] is None else q["x"])
    assert sorted(map(key, out)) == sorted((c, d, -9.0 if x is None else x) for d, c, x, _ in rows)
    for q in out:
        inside = [x for d, c, x, _ in rows if c == q["code"] and x is not None and 0 <= (q["date"] - d).days < 30]
        for name, p in (("q2", 0.2), ("q9", 0.9)):
            assert q[name] == (interpolated(inside, p) if inside else None)


def q_by_definition(bars, days, share):
    """Each window sorted anew, bar by bar."""
    out = {}
    for code, g in bars.groupby("code"):
        g = g.sort_values(["date", "seq"]).reset_index(drop=True)
        dates = sorted(g["date"].unique())
        for i in range(days - 1, len(dates)):
            w = g[g["date"].isin(dates[i - days + 1 : i + 1])].reset_index(drop=True)
            r4 = (w["close"] / w["close"].shift(1) - 1).abs()
            scores = {"s1": w["s1"], "s2": w["s2"], "s3": w["s3"], "s5": w["s5"], "s4": r4.rank() + w["volume"].rank()}
            total, whole = w["volume"].sum(), (w["price"] * w["volume"]).sum() / w["volume"].sum()
            for name, s in scores.items():
                order = sorted(range(len(w)), key=lambda j, s=s: (math.isnan(s[j]), -s[j] if not math.isnan(s[j]) else 0, j))
                run = top = 0.0
                for j in order:
                    if run + w["volume"][j] > share * total:
                        break
                    run, top = run + w["volume"][j], top + w["price"][j] * w["volume"][j]
                out[code, dates[i], name] = top / run / whole if run else None
    return out


@pytest.mark.parametrize("block,days", [(4, 3), (40, 3), (2, 5)])
def test_panes_equal_sorting_each_window(spark, block, days):
    r = random.Random(5)
    rows = [(c, DAY + dt.timedelta(2 * d), s, round(r.uniform(9, 11), 2), 11.5, 8.5, float(r.choice((0, 1, 2, 5, 5, 9, 40)))) for c in "xy" for d in range(14) for s in range(r.choice((1, 6, 12)))]
    bars = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume double").repartition(4)
    scored = intraday.smart_scores(bars).toPandas()
    want = q_by_definition(scored, days, 0.2)
    out = {(q["code"], q["date"], q["score"]): q["q"] for q in intraday.smart_money(bars, days, 0.2, block).collect()}
    assert set(out) == set(want) and any(v is None for v in want.values())
    for k, v in want.items():
        assert (out[k] is None) == (v is None) and (v is None or out[k] == pytest.approx(v, rel=1e-9)), k


@pytest.mark.parametrize("rows_a_slice", [1, 8])
def test_slices_of_values_equal_sorting_each_window(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(intraday, "SLICE_ROWS", rows_a_slice)  # slices by both kinds of cells
    r = random.Random(6)
    price = {"x": lambda: round(r.uniform(9, 11), 2), "y": lambda: r.choice((10.0, 10.0, 12.0)), "z": lambda: math.exp(r.uniform(-5, 5))}
    rows = [(c, DAY + dt.timedelta(d), s, p(), 11.5, 8.5, float(r.choice((0, 1, 2, 5, 5, 9, 40)))) for c, p in price.items() for d in range(9) for s in range(r.choice((1, 6, 12)))]
    bars = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume double").repartition(4)
    want = q_by_definition(intraday.smart_scores(bars).toPandas(), 3, 0.2)
    out = {(q["code"], q["date"], q["score"]): q["q"] for q in intraday.smart_money(bars, 3, 0.2, 4).collect()}
    assert set(out) == set(want)
    for k, v in want.items():
        assert (out[k] is None) == (v is None) and (v is None or out[k] == pytest.approx(v, rel=1e-9)), k


def test_no_task_of_smart_money_gets_a_window_s_bars(spark, monkeypatch, tmp_path):
    sizes = str(tmp_path)

    def watched(df, keys, fn, schema):
        def run(g):
            with open(f"{sizes}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(g)))
            return fn(g)

        return df.groupBy(*keys).applyInPandas(run, schema)

    monkeypatch.setattr(intraday, "grouped_apply", watched)
    r = random.Random(8)
    rows = [("x", DAY + dt.timedelta(d), s, r.choice((9.0, 10.0, 12.0)), 12.5, 8.5, r.choice((2, 5, 9))) for d in range(4) for s in range(400)]
    bars = spark.createDataFrame(rows, "code string, date date, seq long, close double, high double, low double, volume int")
    assert intraday.smart_money(bars, 3, 0.2).count() == 10
    # A window has 1200 bars; of a day's bars with the same value a task gets one row.
    assert 0 < max(int((tmp_path / f).read_text()) for f in os.listdir(sizes)) < 100


def test_inversions_equal_all_pairs():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 64, 65, 300):
        for top in (1, 3, 1000):
            v = r.integers(0, top, size=n).astype(float)
            assert cross.inversions(v) == sum(a > b for a, b in combinations(v.tolist(), 2))


def tau_b(pairs):
    score = tx = ty = 0
    for (a, b), (c, d) in combinations(pairs, 2):
        dx, dy = (a > c) - (a < c), (b > d) - (b < d)
        score, tx, ty = score + dx * dy, tx + (dx == 0), ty + (dy == 0)
    n = len(pairs) * (len(pairs) - 1) // 2
    return None if n in (tx, ty) else score / math.sqrt((n - tx) * (n - ty))


@pytest.mark.parametrize("rows_a_part,parts", [(8192, 64), (10, 64), (25, 7), (1, 2)])
def test_kendall_equals_all_pairs_for_any_parts(spark, monkeypatch, rows_a_part, parts):
    monkeypatch.setattr(cross, "PART_ROWS", rows_a_part)
    monkeypatch.setattr(cross, "MOST_PARTS", parts)
    r = random.Random(7)
    data = {
        "noise": [(r.random(), r.random()) for _ in range(300)],
        "line": [(i, 2 * i + r.random()) for i in range(200)],
        "falls": [(i, -i) for i in range(50)],
        "ties": [(r.randrange(4), r.randrange(3)) for _ in range(250)],
        "hot": [(1.0 if r.random() < 0.5 else r.random(), r.random() if r.random() < 0.6 else 0.5) for _ in range(250)],
        "flat": [(1.0, r.random()) for _ in range(20)],
        "one": [(1.0, 2.0)],
    }
    rows = [(k, float(a), float(b)) for k, pairs in data.items() for a, b in pairs] + [("noise", None, 1.0), ("noise", 1.0, None), ("empty", None, None)]
    out = {q["date"]: q["corr"] for q in cross.correlation(spark.createDataFrame(rows, "date string, x double, y double").repartition(5), "x", "y", method="kendall").collect()}
    assert set(out) == set(data)
    for k, pairs in data.items():
        want = tau_b(pairs)
        assert (out[k] is None) == (want is None) and (want is None or out[k] == pytest.approx(want, abs=1e-12)), k


@pytest.mark.parametrize("strict", [True, False])
def test_the_next_row_after_equals_a_search(spark, strict):
    r = random.Random(3)
    left = [(r.choice("abc"), DAY + dt.timedelta(r.randrange(60)), i) for i in range(150)] + [(None, DAY, 900), ("a", None, 901), ("d", DAY, 902)]
    right = sorted({(c, DAY + dt.timedelta(r.randrange(60))) for c in "abc" for _ in range(12)})
    marks = [(c, d, f"{c}{d}") for c, d in right] + [(None, DAY, "none"), ("a", None, "no day")]
    out = timing.next_after(spark.createDataFrame(left, "code string, date date, i int").repartition(3), spark.createDataFrame(marks, "code string, date date, mark string"), ["code"], strict=strict).collect()
    assert sorted(q["i"] for q in out) == sorted(i for _, _, i in left)
    for q in out:
        later = [d for c, d in right if q["code"] is not None and q["date"] is not None and c == q["code"] and (d > q["date"] or not strict and d == q["date"])]
        want = min(later, default=None)
        assert q["next_date"] == want and q["mark"] == (want and f"{q['code']}{want}")
    with pytest.raises(ValueError, match="share names"):
        timing.next_after(spark.range(1).selectExpr("id as code", "date'2001-01-01' as date", "1 as x"), spark.range(1).selectExpr("id as code", "date'2001-01-01' as date", "2 as x"), ["code"])


def test_residuals_equal_least_squares_on_large_values(spark):
    r = np.random.default_rng(4)
    n = 200
    x1, x2 = 1e9 + r.normal(size=n), 3e9 + 1e3 * r.normal(size=n)
    y = 5e9 + 2 * x1 - 0.001 * x2 + r.normal(size=n)
    rows = [("d", str(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, x1, x2, strict=True))] + [("d", "hole", 1.0, None, 2.0)]
    out = {q["code"]: q["fac"] for q in cross.regress_out(spark.createDataFrame(rows, "date string, code string, y double, x1 double, x2 double").repartition(4), "y", ["x1", "x2"]).collect()}
    design = np.column_stack([np.ones(n), x1 - x1.mean(), x2 - x2.mean()])
    beta = np.linalg.lstsq(design, y - y.mean(), rcond=None)[0]
    want = y - y.mean() - design @ beta
    assert out.pop("hole") is None and np.allclose([out[str(i)] for i in range(n)], want, atol=1e-5)


def test_a_factor_that_depends_on_another_adds_nothing(spark):
    r = np.random.default_rng(6)
    a, y = r.normal(size=50), r.normal(size=50)
    rows = [("d", str(i), float(y[i]), float(a[i]), float(3 * a[i] - 1), 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "date string, code string, y double, a double, b double, flat double")
    one = {q["code"]: q["fac"] for q in cross.regress_out(df, "y", ["a"]).collect()}
    out = {q["code"]: q["fac"] for q in cross.regress_out(df, "y", ["a", "b", "flat"]).collect()}
    assert all(out[c] == pytest.approx(one[c], abs=1e-9) for c in one)


def test_blocks_carry_what_is_looked_back_on(spark):
    df = spark.range(20).withColumn("at", F.col("id"))
    out = rolling_order.with_halo(df, F.col("at"), 5, 3).toPandas()
    assert sorted(out.loc[out["_own"], "id"]) == list(range(20))
    for block, g in out.groupby("_block"):
        own = {i for i in range(20) if i // 5 == block}
        assert set(g["id"]) == {i for i in range(20) if any(0 <= o - i <= 3 for o in (own or range(5 * block, 5 * block + 5)))}
    assert isinstance(out, pd.DataFrame)


def test_box_cox_finds_the_least_variance_of_a_fine_grid(spark):
    r = np.random.default_rng(8)
    data = {"log": np.exp(r.normal(size=300)), "root": (5 + r.normal(size=300)) ** 2, "large": 1e5 + 1e4 * r.gamma(2.0, size=300), "huge": np.exp(150 + r.normal(size=100)), "two": np.array([1.0, 3.0])}
    rows = [(k, str(i), float(v)) for k, xs in data.items() for i, v in enumerate(xs)] + [("log", "zero", 0.0), ("log", "none", None), ("minus", "a", -1.0), ("minus", "b", 2.0), ("flat", "a", 2.0), ("flat", "b", 2.0), ("alone", "a", 2.0)]
    df = spark.createDataFrame(rows, "date string, code string, fac double").repartition(4)
    found = {q["date"]: q["lambda"] for q in cross.box_cox_lambdas(df).collect()}
    assert set(found) == set(data)
    out = {(q["date"], q["code"]): q["fac"] for q in cross.box_cox(df).collect()}
    assert len(out) == len(rows) and all(out[k] is None for k in [("log", "zero"), ("log", "none"), ("minus", "a"), ("minus", "b"), ("flat", "a"), ("alone", "a")])
    for k, xs in data.items():
        z = np.log(xs) - np.log(xs).mean()
        spread = lambda lam, z=z: z.var() if abs(lam) < 1e-9 else (np.expm1(lam * z) / lam).var()
        grid = np.linspace(-5, 5, 20001)
        best = grid[np.argmin([spread(g) for g in grid])]
        assert abs(found[k] - best) <= 5.1e-4 and spread(found[k]) <= spread(best) * (1 + 1e-12)
        lam = found[k]
        assert out[k, "1"] == pytest.approx(float(np.expm1(lam * np.log(xs[1])) / lam), rel=1e-12)
