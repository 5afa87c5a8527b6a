"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

_UNIT = "l_extendedprice / l_quantity"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_BAR = f"""round(first({_UNIT} ORDER BY {_ORDER}), 4) AS open, round(max({_UNIT}), 4) AS high, round(min({_UNIT}), 4) AS low, round(last({_UNIT} ORDER BY {_ORDER}), 4) AS last,
round(avg({_UNIT}), 4) AS mean, round(sum(l_quantity), 2) AS vol, round(sum(l_extendedprice), 2) AS amount"""
_N = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 - ({_UP(x)}) ELSE {_UP(x)} END)"


def _UP(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    return f"exp(-{x} * {x} / 2) / sqrt(2 * pi()) * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"


_BASE = f"""WITH RECURSIVE panel AS (SELECT date, code, open, high, low, mean AS close, vol, amount FROM (
  SELECT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey::VARCHAR AS code, {_BAR} FROM lineitem GROUP BY 1, 2)),
idx AS (SELECT *, close / pre_close - 1 AS pct_change FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS pre_close FROM (
  SELECT date, code, open, high, low, last AS close, vol FROM (SELECT l_shipdate::DATE AS date, l_returnflag AS code, {_BAR} FROM lineitem GROUP BY 1, 2)))),
tame AS (SELECT * REPLACE (CASE WHEN pct_change IS NOT NULL THEN round(greatest(-0.5, least(0.5, pct_change)) / 100, 8) END AS pct_change) FROM idx),
bars AS (SELECT event_type AS code, ts::DATE AS date, event_id AS seq, value AS close, value * 1.01 AS high, value * 0.99 AS low, (props->>'$.k')::INT + 1 AS volume, round(value * ((props->>'$.k')::INT + 1), 2) AS amount FROM events),
bret AS (SELECT * FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date, seq), 0) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
attr AS (SELECT s_suppkey::VARCHAR AS code, s_nationkey AS industry, s_acctbal AS circ_mv FROM supplier),
fac AS (SELECT date, code, amount AS fac FROM panel),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS didx FROM (SELECT DISTINCT date FROM panel)),
grid AS (SELECT panel.*, didx FROM panel JOIN days USING (date)),
pret AS (SELECT date, code, open / nullif(max(open) OVER (PARTITION BY code ORDER BY didx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1 AS ret,
  max(amount) OVER (PARTITION BY code ORDER BY didx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fac FROM grid),
pairs AS (SELECT date, code, ret, fac FROM pret WHERE ret IS NOT NULL AND fac IS NOT NULL),
grp AS (SELECT date, code, ret, fac, (CASE WHEN e = 0 THEN 5 ELSE least(5, (rn - 1) // e + 1) END)::INT AS grp FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY fac, code) AS rn, round_even(count(*) OVER (PARTITION BY date) / 5, 0)::BIGINT AS e FROM pairs)),
rets AS (SELECT code AS strategy, date, ret, round(avg(ret) OVER (PARTITION BY date), 10) AS bench FROM (SELECT code, date, pct_change AS ret FROM tame WHERE pct_change IS NOT NULL)),
book AS (SELECT o_orderkey AS opt_id, o_orderpriority AS book, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS cp, (50 + o_orderkey % 101)::DOUBLE AS s, (60 + o_orderkey % 83)::DOUBLE AS k,
  (o_orderkey % 24 + 1) / 12.0::DOUBLE AS t, 0.03::DOUBLE AS r, 0.1::DOUBLE + (o_orderkey % 40) / 100.0::DOUBLE AS v, (o_orderkey % 3) / 100.0::DOUBLE AS q, (o_orderkey % 21 - 10)::INT AS contracts, 100 AS multiplier FROM orders),
dd AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM book),
gr AS (SELECT *, CASE WHEN cp = 'C' THEN exp(-q * t) * {_N('d1')} ELSE exp(-q * t) * ({_N('d1')} - 1) END AS delta, exp(-q * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (s * v * sqrt(t)) AS gamma,
  s * exp(-q * t) * sqrt(t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS vega,
  -s * exp(-q * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * v / (2 * sqrt(t)) + CASE WHEN cp = 'C' THEN -r * k * exp(-r * t) * {_N('d2')} + q * s * exp(-q * t) * {_N('d1')}
    ELSE r * k * exp(-r * t) * (1 - {_N('d2')}) - q * s * exp(-q * t) * (1 - {_N('d1')}) END AS theta FROM dd)
"""
_Z = lambda c: f"({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0)"
_MAD = """, med AS (SELECT date, quantile_cont(fac, 0.5) AS m FROM fac GROUP BY 1), mad AS (SELECT date, m, quantile_cont(abs(fac - m), 0.5) AS d FROM fac JOIN med USING (date) GROUP BY 1, 2),
b AS (SELECT date, code, fac, d, m - 2 * d AS lo, m + 2 * d AS hi FROM fac JOIN mad USING (date)) """
_RANK = lambda c, over: f"(rank() OVER (PARTITION BY {over} ORDER BY {c}) + (count(*) OVER (PARTITION BY {over}, {c}) - 1) / 2.0)"
_SKEW = lambda c: f"(avg(power({c}, 3)) - 3 * avg({c}) * avg({c} * {c}) + 2 * power(avg({c}), 3)) / power(var_pop({c}), 1.5)"
_ROWS = "(PARTITION BY code ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_AVG = lambda c, n: f"(CASE WHEN count({c}) OVER {_ROWS.format(n - 1)} >= {n} THEN avg({c}) OVER {_ROWS.format(n - 1)} END)"
_WMA = "(close + 2 * lag(close) OVER w + 3 * lag(close, 2) OVER w + 4 * lag(close, 3) OVER w) / 10"
_EVENTS = """, ev AS (SELECT date, code, lo, so FROM (SELECT date, code, close > quantile_cont(close, 0.8) OVER q AS lo, close < quantile_cont(close, 0.2) OVER q AS so, min(date) OVER (PARTITION BY code) AS f FROM idx
WINDOW q AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)) WHERE date >= f + 365),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM ev) """
#: A number of any size as digits and a power of ten.
_DIGITS = lambda x, name: f"round({x} / power(10.0::DOUBLE, floor(log10(CASE WHEN abs({x}) >= 1e-6 THEN abs({x}) ELSE 1 END))), 6) + 0 AS {name}, CASE WHEN {x} IS NOT NULL THEN floor(log10(CASE WHEN abs({x}) >= 1e-6 THEN abs({x}) ELSE 1 END))::INT END AS {name}_power"
_CLAMP = lambda s: f"CASE WHEN {s} >= 0 THEN 1.0 WHEN {s} <= -1 THEN 0.0 ELSE 1 + {s} END"
_PERF = lambda x: f""", base AS ({x}), lev AS (SELECT *, 1 + sum(ret) OVER (PARTITION BY strategy ORDER BY date) AS l FROM base), dr AS (SELECT strategy, max(1 - l / top) AS md FROM (SELECT *, max(l) OVER (PARTITION BY strategy ORDER BY date) AS top FROM lev) GROUP BY 1)
SELECT strategy, round(total, 6) + 0 AS total, round(annual, 6) + 0 AS annual, round(vol, 6) AS vol, round(win, 6) AS win, round(md, 6) AS max_drawdown, round(annual / vol, 6) + 0 AS sharpe FROM (
SELECT strategy, sum(ret) AS total, sum(ret) * 365 / (max(date) - min(date)) AS annual, stddev_pop(ret) * sqrt(252) AS vol, count(*) FILTER (ret > 0) / count(ret) AS win FROM base GROUP BY 1) JOIN dr USING (strategy)"""  # noqa: E731
#: A factor's values over all prices of its dates, its signs, and the means of each date's skewness and correlation with the date before.
_COVER = lambda f, rows: f""", cv AS (SELECT date, count({f}) AS n, count(*) FILTER ({f} > 0) AS up, count(*) FILTER ({f} < 0) AS down, skewness({f}) AS s, corr({f}, b) AS a FROM (
SELECT *, max({f}) OVER (PARTITION BY code ORDER BY didx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b FROM {rows}) GROUP BY 1 HAVING count({f}) > 0),
ca AS (SELECT least(1, sum(n) / (SELECT count(nullif(open, 0)) FROM panel WHERE date IN (SELECT date FROM cv))) AS c, sum(up) / (sum(up) + sum(down)) AS p, avg(s) AS s, avg(a) AS a FROM cv) """  # noqa: E731
_COIN = ", x AS (SELECT * FROM (SELECT date, code, vol, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel) WHERE ret IS NOT NULL) "
_EFFECT = """, chg AS (SELECT date, code, close / nullif(lag(close, 3) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS c FROM panel), cnt AS (SELECT date, count(*) FILTER (c > 0.05) AS pos, count(*) FILTER (c < -0.05) AS neg FROM chg GROUP BY 1),
eff AS (SELECT *, CASE WHEN pos > 20 THEN 1 WHEN neg > 25 THEN -1 ELSE 0 END AS effect FROM cnt) """
#: Monthly index rows with their mean, the account's rows (numbered, with the signal of the row before), and the account itself.
_MONTHS = ", mon AS (SELECT date_trunc('month', date)::DATE AS date, code, arg_min(open, idx.date) AS open, arg_max(close, idx.date) AS close FROM idx GROUP BY 1, 2), mas AS (SELECT *, CASE WHEN count(close) OVER w >= 3 THEN avg(close) OVER w END AS ma FROM mon WINDOW w AS (PARTITION BY code ORDER BY date ROWS 2 PRECEDING)) "
_SIGNAL = "CASE WHEN effect = -1 THEN -1 WHEN effect = 1 AND close > ma THEN 1 ELSE 0 END"
_ACCOUNT = lambda rows: f""", sg AS ({rows}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS i, coalesce(lag(signal) OVER (PARTITION BY key ORDER BY date), 0) AS before FROM sg),
acc AS (SELECT key, i, date, close, 1e6::DOUBLE AS cash, 0::BIGINT AS shares, NULL::DOUBLE AS entry, NULL::DOUBLE AS trade FROM n WHERE i = 1 UNION ALL
SELECT n.key, n.i, n.date, n.close, CASE WHEN before > 0 AND shares = 0 AND n.open > 0 THEN cash - floor(cash / n.open) * n.open WHEN before < 0 AND shares > 0 THEN cash + shares * n.open ELSE cash END,
CASE WHEN before > 0 AND shares = 0 AND n.open > 0 THEN floor(cash / n.open)::BIGINT WHEN before < 0 THEN 0 ELSE shares END, CASE WHEN before > 0 AND shares = 0 AND n.open > 0 THEN n.open ELSE entry END,
CASE WHEN before < 0 AND shares > 0 THEN n.open / entry - 1 END FROM acc JOIN n ON n.key = acc.key AND n.i = acc.i + 1),
eq AS (SELECT *, cash + shares * close AS e FROM acc), tr AS (SELECT key, trade AS t FROM acc WHERE trade IS NOT NULL UNION ALL SELECT key, arg_max(close / entry - 1, i) AS t FROM acc GROUP BY 1 HAVING arg_max(shares, i) > 0),
dr AS (SELECT key, date, e, e / max(e) OVER (PARTITION BY key ORDER BY i) - 1 AS d, coalesce(e / lag(e) OVER (PARTITION BY key ORDER BY i) - 1, 0) AS r FROM eq),
st AS (SELECT key, arg_max(e, date) / 1e6 - 1 AS total, min(d) AS max_drawdown, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, max(date) - min(date) AS days FROM dr GROUP BY 1),
tt AS (SELECT key, count(*) AS n_trades, count(*) FILTER (t > 0) / count(*) AS win, avg(t) FILTER (t > 0) / abs(avg(t) FILTER (t < 0)) AS pl_ratio, avg(t) AS mean_ret FROM tr GROUP BY 1) """  # noqa: E731
_STATS = "round(total, 6) + 0 AS total, round(total * 365 / days, 6) + 0 AS annual, round(max_drawdown, 6) + 0 AS max_drawdown, round(sharpe, 6) + 0 AS sharpe, coalesce(n_trades, 0) AS n_trades, round(win, 6) AS win, round(pl_ratio, 6) AS pl_ratio, round(mean_ret, 6) + 0 AS mean_ret"
_ONE_ACCOUNT = _EFFECT + _MONTHS + _ACCOUNT(f"SELECT code AS key, date, open, close, {_SIGNAL} AS signal FROM mas LEFT JOIN eff USING (date)")
#: The trend and resonance rules.
_SHORT = f""", wm AS (SELECT date, code, close, vol, {_WMA} AS wma FROM idx WINDOW w AS (PARTITION BY code ORDER BY date)), sh AS (SELECT *, coalesce(wma - lag(wma, 10) OVER (PARTITION BY code ORDER BY date) < 0 AND {_AVG('close', 5)} < {_AVG('close', 90)}, FALSE) AS short, coalesce({_AVG('close', 5)} > {_AVG('close', 90)}, FALSE) AS rises FROM wm),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM sh),
r AS (SELECT code, i, date, short, close AS a, close AS b, 1.0::DOUBLE AS t, 1.0::DOUBLE AS c FROM n WHERE i = 1 UNION ALL
SELECT code, i, date, short, a, b, a / b, c + 2 / 13 * (a / b - c) FROM (SELECT n.code, n.i, n.date, n.short, r.a + 2 / 11 * (n.close - r.a) AS a, r.b + 2 / 27 * (n.close - r.b) AS b, r.c FROM r JOIN n ON n.code = r.code AND n.i = r.i + 1)),
trend AS (SELECT date, code, t, t / c AS g, short, t > 1 AND t / c > 1 AND NOT short AS long FROM r) """
_RESONANCE = f""", m AS (SELECT *, power(abs(vol - lag(vol, 10) OVER (PARTITION BY code ORDER BY date)) / nullif(CASE WHEN count(st) OVER w >= 10 THEN sum(st) OVER w END, 0) * (2 / 3 - 2 / 31) + 2 / 31, 2) AS sc
  FROM (SELECT *, abs(vol - lag(vol) OVER (PARTITION BY code ORDER BY date)) AS st FROM n) WINDOW w AS (PARTITION BY code ORDER BY date ROWS 9 PRECEDING)),
f AS (SELECT code, avg(vol) AS a FROM n WHERE i <= 10 GROUP BY 1),
am AS (SELECT m.code, m.i, f.a FROM m JOIN f USING (code) WHERE i <= 10 UNION ALL SELECT m.code, m.i, CASE WHEN m.sc IS NULL THEN am.a ELSE am.a + m.sc * (m.vol - am.a) END FROM am JOIN m ON m.code = am.code AND m.i = am.i + 1 WHERE am.i >= 10),
en AS (SELECT n.date, n.code, n.rises, a, {_AVG('close', 50)} AS bma FROM n JOIN am USING (code, i)),
e2 AS (SELECT date, code, rises, bma / nullif(lag(bma, 3) OVER (PARTITION BY code ORDER BY date), 0) AS p, {_AVG('a', 5)} / nullif({_AVG('a', 100)}, 0) AS v FROM en),
res AS (SELECT date, code, rises, p, v, p * v AS x, coalesce(p * v > CASE WHEN rises THEN 1.125 ELSE 1.275 END, FALSE) AS long FROM e2) """
_PRICED = "p AS (SELECT *, (opt_id % 9 + 1) * 1000.0::DOUBLE AS margin, (opt_id % 11 - 5) / 2.0::DOUBLE AS ds, (opt_id % 5 - 2) / 100.0::DOUBLE AS dv, greatest(CASE WHEN cp = 'C' THEN s - k ELSE k - s END, 0) AS intrinsic, opt_id % 13 / 4.0::DOUBLE AS tv FROM gr) "
_BENCH = ", bm AS (SELECT date, p / nullif(lag(p) OVER (ORDER BY date), 0) - 1 AS b FROM (SELECT date, round(avg(open), 4) AS p FROM panel GROUP BY 1)) "
_LEGS = """, legs AS (SELECT date, avg(ret) FILTER (grp = 1) AS f, avg(ret) FILTER (grp = 5) AS l, avg(ret) AS market FROM grp GROUP BY 1), way AS (SELECT CASE WHEN sum(f - l) > 0 THEN 1 ELSE -1 END AS w FROM legs),
ls AS (SELECT date, CASE WHEN w > 0 THEN f ELSE l END AS long, CASE WHEN w > 0 THEN l ELSE f END AS short, market FROM legs, way) """
_IC = f""", m AS (SELECT date, quantile_cont(fac, 0.5) AS m FROM pairs GROUP BY 1), h AS (SELECT p.*, fac <= m AS lo, fac >= m AS hi FROM pairs p JOIN m USING (date)),
a AS (SELECT date, corr(x, y) AS ic FROM (SELECT date, {_RANK('fac', 'date')} AS x, {_RANK('ret', 'date')} AS y FROM h) GROUP BY 1),
l AS (SELECT date, corr(x, y) AS ic_low FROM (SELECT date, {_RANK('fac', 'date')} AS x, {_RANK('ret', 'date')} AS y FROM h WHERE lo) GROUP BY 1),
u AS (SELECT date, corr(x, y) AS ic_high FROM (SELECT date, {_RANK('fac', 'date')} AS x, {_RANK('ret', 'date')} AS y FROM h WHERE hi) GROUP BY 1),
ic AS (SELECT date, ic, ic_low, ic_high FROM a LEFT JOIN l USING (date) LEFT JOIN u USING (date)) """

ORACLE: dict[str, str] = {name: _BASE + sql for name, sql in {
    "read_daily_weekly": "SELECT date_trunc('week', date)::DATE + 6 AS date, code, round(arg_max(close, idx.date), 6) AS close FROM idx GROUP BY 1, 2",
    "read_market_monthly": "SELECT last_day(date) AS date, code, round(arg_max(close, idx.date), 6) AS close FROM idx WHERE code = 'N' GROUP BY 1, 2",
    "high_water_mark": "SELECT max(date) AS date FROM (SELECT date FROM idx GROUP BY 1 HAVING count(DISTINCT code) >= 2)",
    "tradable_mask": """SELECT date, f.code, CASE WHEN (f.code::INT + month(date)) % 7 = 0 AND month(date) % 2 = 0 THEN NULL ELSE round(fac, 6) END AS fac FROM fac f
WHERE f.code NOT IN (SELECT code FROM attr WHERE (CASE WHEN circ_mv < 0 THEN DATE '1998-06-01' ELSE DATE '1990-01-01' END) + 365 > (SELECT max(date) FROM fac))""",
    "zscore": f"SELECT date, code, round({_Z('fac')}, 6) + 0 AS fac FROM fac",
    "zscore_all_pos": f"SELECT date, code, round(z - min(z) OVER (PARTITION BY date), 6) + 0 AS fac FROM (SELECT date, code, {_Z('fac')} AS z FROM fac)",
    "clip_mad_replace": _MAD + "SELECT date, code, round(least(greatest(fac, lo), hi) * abs(sign(fac)), 6) + 0 AS fac FROM b",
    "clip_mad_null": _MAD + "SELECT date, code, CASE WHEN fac BETWEEN lo AND hi THEN round(fac, 6) END AS fac FROM b",
    "clip_mad_trend": _MAD + """, t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN fac <= lo THEN -1 WHEN fac >= hi THEN 1 ELSE 0 END AS side FROM b),
p AS (SELECT *, coalesce((row_number() OVER (PARTITION BY date, side ORDER BY fac, code) - 1) / nullif(count(*) OVER (PARTITION BY date, side) - 1, 0), 1.0) AS place FROM t)
SELECT date, code, round(CASE side WHEN -1 THEN lo - 0.5 * d + 0.5 * d * place WHEN 1 THEN hi + 0.5 * d * place ELSE fac END, 6) + 0 AS fac FROM p""",
    "clip_sigma": "SELECT date, code, CASE WHEN abs(fac - avg(fac) OVER (PARTITION BY date)) <= 2 * stddev_samp(fac) OVER (PARTITION BY date) THEN round(fac, 6) END AS fac FROM fac",
    "clip_pct": ", b AS (SELECT date, quantile_cont(fac, 0.025) AS lo, quantile_cont(fac, 0.975) AS hi FROM fac GROUP BY 1) SELECT date, code, CASE WHEN fac BETWEEN lo AND hi THEN round(fac, 6) END AS fac FROM fac JOIN b USING (date)",
    "qcut_group": """, e AS (SELECT date, list_distinct(quantile_cont(fac, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM fac GROUP BY 1)
SELECT date, code, round(fac, 6) AS fac, greatest(len(list_filter(edges, lambda x: x < fac)) - 1, 0)::INT AS label FROM fac JOIN e USING (date)""",
    "abs_dist": ", b AS (SELECT date, quantile_cont(fac, 0.5) AS m FROM fac GROUP BY 1) SELECT date, code, round(abs(fac - m), 6) AS fac FROM fac JOIN b USING (date)",
    "coin_reverse": _COIN + "SELECT date, code, round(ret * sign(vol - m), 6) + 0 AS fac FROM x JOIN (SELECT date, avg(vol) AS m FROM x GROUP BY 1) USING (date)",
    "coin_reverse_split": _COIN + """SELECT date, code, round(nullif(ret * sign(vol - CASE WHEN ret > 0 THEN u ELSE d END), 0), 6) + 0 AS fac FROM x
JOIN (SELECT date, quantile_cont(CASE WHEN ret > 0 THEN vol WHEN ret = 0 THEN 0 END, 0.5) AS u, quantile_cont(CASE WHEN ret < 0 THEN vol WHEN ret = 0 THEN 0 END, 0.5) AS d FROM x GROUP BY 1) USING (date)""",
    "add_zscores": f"SELECT date, code, round({_Z('amount')} + {_Z('vol')}, 6) + 0 AS fac FROM panel",
    "neutral_size": """SELECT date, code, round(fac - a - b * circ_mv, 3) + 0 AS fac FROM fac JOIN attr USING (code) JOIN (SELECT date, regr_slope(fac, circ_mv) AS b, regr_intercept(fac, circ_mv) AS a FROM fac JOIN attr USING (code) GROUP BY 1) USING (date)""",
    "de_cross": """, mo AS (SELECT date, avg(amount) AS y, avg(vol) AS a, avg(close) AS b, covar_pop(vol, vol) AS aa, covar_pop(close, close) AS bb, covar_pop(vol, close) AS ab, covar_pop(vol, amount) AS ay, covar_pop(close, amount) AS yb FROM panel GROUP BY 1)
SELECT date, code, round(amount - y - (ay * bb - yb * ab) / (aa * bb - ab * ab) * (vol - a) - (yb * aa - ay * ab) / (aa * bb - ab * ab) * (close - b), 4) + 0 AS fac FROM panel JOIN mo USING (date)""",
    "neutral_industry": "SELECT date, code, round(fac - avg(fac) OVER (PARTITION BY date, industry), 6) + 0 AS fac FROM fac JOIN attr USING (code)",
    "preprocess_pipeline": f""", med AS (SELECT date, quantile_cont(fac, 0.5) AS m FROM fac JOIN attr USING (code) GROUP BY 1), mad AS (SELECT date, m, quantile_cont(abs(fac - m), 0.5) AS d FROM fac JOIN attr USING (code) JOIN med USING (date) GROUP BY 1, 2),
c AS (SELECT date, code, industry, circ_mv, least(greatest(fac, m - 3 * d), m + 3 * d) AS fac FROM fac JOIN attr USING (code) JOIN mad USING (date)),
s AS (SELECT c.date, code, industry, fac - a - b * circ_mv AS fac FROM c JOIN (SELECT date, regr_slope(fac, circ_mv) AS b, regr_intercept(fac, circ_mv) AS a FROM c GROUP BY 1) USING (date)),
i AS (SELECT date, code, fac - avg(fac) OVER (PARTITION BY date, industry) AS fac FROM s) SELECT date, code, round({_Z('fac')}, 6) + 0 AS fac FROM i""",
    "cs_corr": f"SELECT date, round(corr(x, y), 6) + 0 AS corr FROM (SELECT date, {_RANK('amount', 'date')} AS x, {_RANK('close', 'date')} AS y FROM panel) GROUP BY 1",
    "cs_corr_kendall": """SELECT date, round(sum(s) / sqrt(count(*) FILTER (x <> 0)::DOUBLE * count(*) FILTER (y <> 0)::DOUBLE), 6) + 0 AS corr FROM (SELECT a.date, sign(a.amount - b.amount) AS x, sign(a.close - b.close) AS y, sign(a.amount - b.amount) * sign(a.close - b.close) AS s
FROM panel a JOIN panel b ON a.date = b.date AND a.code < b.code) GROUP BY 1""",
    "ts_corr": "SELECT code, round(corr(amount, close), 6) + 0 AS corr FROM panel GROUP BY 1",
    "corr_matrix": """, c AS (SELECT date, corr(amount, vol) AS av, corr(amount, close) AS ac, corr(vol, close) AS vc FROM panel GROUP BY 1), m AS (SELECT avg(av) AS av, avg(ac) AS ac, avg(vc) AS vc FROM c)
SELECT "left", "right", round(corr, 6) + 0 AS corr FROM (SELECT unnest(['amount', 'vol', 'amount', 'close', 'vol', 'close', 'amount', 'vol', 'close']) AS "left", unnest(['vol', 'amount', 'close', 'amount', 'close', 'vol', 'amount', 'vol', 'close']) AS "right", unnest([av, av, ac, ac, vc, vc, 1.0, 1.0, 1.0]) AS corr FROM m)""",
    "merge_many": "SELECT date, code, round(amount, 6) AS amount, round(vol, 6) AS vol, round(close, 6) AS close FROM panel",
    "list_std": f"SELECT date, code, round(sqrt((power(a - m, 2) + power(v - m, 2) + power(c - m, 2)) / 3), 6) AS fac FROM (SELECT *, (a + v + c) / 3 AS m FROM (SELECT date, code, {_Z('amount')} AS a, {_Z('vol')} AS v, {_Z('close')} AS c FROM panel))",
    "smooth_daily": "SELECT date, code, round(CASE WHEN count(amount) OVER w >= 3 THEN avg(amount) OVER w END, 6) + 0 AS fac FROM grid WINDOW w AS (PARTITION BY code ORDER BY didx RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)",
    "smooth_weekly": """, g AS (SELECT idx.*, d FROM idx JOIN (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM idx)) USING (date)),
s AS (SELECT date, code, CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS fac FROM g WINDOW w AS (PARTITION BY code ORDER BY d RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date_trunc('week', date)::DATE + 6 AS date, code, round(arg_max(fac, s.date), 6) AS fac FROM s WHERE fac IS NOT NULL GROUP BY 1, 2""",
    "vov": f"""SELECT date, code, round(CASE WHEN count(z) OVER w >= 6 THEN stddev_samp(z) OVER w END, 6) + 0 AS fac FROM (SELECT date, code, didx, {_Z('amount')} AS z FROM grid) WINDOW w AS (PARTITION BY code ORDER BY didx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "interval_expand": """SELECT kind, date, count(*) AS members, count(DISTINCT code) AS codes FROM (SELECT code, kind, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (SELECT o_custkey::VARCHAR AS code, o_orderpriority AS kind, min(o_orderdate::DATE) AS a,
max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + 20 ELSE DATE '1998-12-31' END) AS b FROM orders GROUP BY 1, 2) WHERE a <= b) GROUP BY 1, 2""",
    "pv_returns": f""", b5 AS (SELECT code, date, avg(s) AS m FROM (SELECT code, date, (rn - 1) // 5 AS b, CASE WHEN max(n) >= 5 THEN sum(ret) END AS s FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq) AS rn, count(*) OVER (PARTITION BY code, date) AS n FROM bret) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT code, date, round(m, 6) + 0 AS rtn5_mean, round(rv, 6) AS real_var, round(sk, 6) + 0 AS rtn_skew, round(ku, 6) + 0 AS rtn_kurt, round(u, 6) AS rv_up, round(d, 6) AS rv_down, round((u - d) / nullif(rv, 0), 6) + 0 AS rv_umd FROM (
SELECT code, date, sum(ret * ret) AS rv, {_SKEW('ret')} AS sk, kurtosis_pop(ret) AS ku, coalesce(sum(ret * ret) FILTER (ret > 0), 0) AS u, coalesce(sum(ret * ret) FILTER (ret < 0), 0) AS d FROM bret GROUP BY 1, 2) JOIN b5 USING (code, date)""",
    "pv_volume": f""", c AS (SELECT code, date, quantile_cont(ln(volume + 1e-6), 0.9) AS q9, quantile_cont(ln(volume + 1e-6), 0.1) AS q1, avg(volume) AS mv FROM bret GROUP BY 1, 2),
x AS (SELECT bret.*, q9, q1, mv, ln(volume + 1e-6) AS lv, sum(volume) OVER (PARTITION BY code, date ORDER BY seq) AS cum FROM bret JOIN c USING (code, date))
SELECT code, date, round({_SKEW('lv')}, 6) + 0 AS vol_skew, round(coalesce(sum(lv) FILTER (lv > q9), 0) / nullif(sum(lv), 0), 6) + 0 AS top_share, round(coalesce(sum(lv) FILTER (lv < q1), 0) / nullif(sum(lv), 0), 6) + 0 AS low_share,
round(avg(cum), 6) AS cum_mean, round(stddev_samp(cum), 6) AS cum_std, round(coalesce(sum(ret) FILTER (volume > mv), 0), 6) + 0 AS pvi FROM x GROUP BY 1, 2""",
    "pv_bars15": f""", b AS (SELECT code, date, (rn - 1) // 15 AS bucket, sum(volume) AS v FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq) AS rn FROM bret) GROUP BY 1, 2, 3),
c AS (SELECT *, v / nullif(lag(v) OVER (PARTITION BY code, date ORDER BY bucket), 0) - 1 AS chg FROM b)
SELECT code, date, CASE WHEN count(*) >= 2 THEN round(arg_min(v, bucket) / sum(v), 6) END AS ovr, CASE WHEN count(*) >= 2 THEN round(arg_max(v, bucket) / sum(v), 6) END AS cvr,
CASE WHEN count(*) >= 2 THEN round({_SKEW('chg')}, 6) + 0 END AS chg_skew, CASE WHEN count(*) >= 2 THEN round(kurtosis_pop(chg), 6) + 0 END AS chg_kurt FROM c GROUP BY 1, 2""",
    "pv_vov": """, p AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq) AS rn, count(*) OVER (PARTITION BY code, date) AS n FROM bret),
i AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY seq) AS r FROM p WHERE rn >= 15 AND rn <= n - 15),
o AS (SELECT code, date, stddev_samp(s) AS vov1 FROM (SELECT code, date, (r - 1) // 5 AS b, sum(ret) AS s FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT code, date, sqrt(sum(power(ln(h / l), 2)) / (4 * ln(2.0) * count(*))) AS vov2 FROM (SELECT code, date, (rn - 1) // 5 AS b, max(high) AS h, min(low) AS l FROM p WHERE n >= 5 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT code, date, round(vov1, 6) AS vov1, round(vov2, 6) AS vov2 FROM (SELECT DISTINCT code, date FROM bret) LEFT JOIN t USING (code, date) LEFT JOIN o USING (code, date)""",
    "smart_money": f""", sc AS (SELECT code, date, seq, volume, close, (close + high + low) / 3 AS price, abs(ret) AS r FROM bret WHERE NOT (ret = 0 AND volume IN (0, 1))),
d AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS d FROM (SELECT DISTINCT code, date FROM sc)),
w AS (SELECT sc.*, e.date AS window_end FROM sc JOIN d USING (code, date) JOIN d e ON e.code = sc.code AND e.d BETWEEN d.d AND d.d + 9 AND e.d >= 10),
w4 AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY code, window_end ORDER BY date, seq), 0) - 1) AS r4 FROM w),
k AS (SELECT *, r / sqrt(volume) AS s1, r / power(volume, 0.1) AS s2, volume::DOUBLE AS s3, CASE WHEN r4 IS NOT NULL THEN {_RANK('r4', 'code, window_end')} + {_RANK('volume', 'code, window_end')} END AS s4, CASE WHEN volume = 1 THEN 'inf'::DOUBLE ELSE r / ln(volume) END AS s5 FROM w4),
l AS (SELECT code, window_end, date, seq, volume, price, unnest(['s1', 's2', 's3', 's4', 's5']) AS score, unnest([s1, s2, s3, s4, s5]) AS s FROM k),
c AS (SELECT *, sum(volume) OVER (PARTITION BY code, window_end, score ORDER BY s DESC NULLS LAST, date, seq ROWS UNBOUNDED PRECEDING) AS run, sum(volume) OVER (PARTITION BY code, window_end, score) AS total FROM l)
SELECT code, window_end AS date, score, round((sum(price * volume) FILTER (run <= 0.2 * total) / sum(volume) FILTER (run <= 0.2 * total)) / (sum(price * volume) / sum(volume)), 6) AS q FROM c GROUP BY 1, 2, 3""",
    "reverse_m": """, q AS (SELECT code, date, quantile_cont(amount / nullif(volume, 0), 15 / 16) AS q, arg_max(close, seq) AS close FROM bars GROUP BY 1, 2), g AS (SELECT q.*, d FROM q JOIN (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM bars)) USING (date)),
r AS (SELECT code, date, q, close / nullif(max(close) OVER (PARTITION BY code ORDER BY d RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1 AS ret, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM g),
w AS (SELECT r.*, e.date AS wend FROM r JOIN r e ON r.code = e.code AND e.n BETWEEN r.n AND r.n + 19 AND e.n >= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY code, wend ORDER BY q DESC, date) AS hi, row_number() OVER (PARTITION BY code, wend ORDER BY q, date) AS lo FROM w)
SELECT code, wend AS date, round(coalesce(sum(ret) FILTER (hi <= 10), 0), 6) + 0 AS m_high, round(coalesce(sum(ret) FILTER (lo <= 10), 0), 6) + 0 AS m_low, round(coalesce(sum(ret) FILTER (hi <= 10), 0) - coalesce(sum(ret) FILTER (lo <= 10), 0), 6) + 0 AS m FROM k GROUP BY 1, 2""",
    "rank_ic": _IC + "SELECT date, round(ic, 6) + 0 AS ic, round(ic_low, 6) + 0 AS ic_low, round(ic_high, 6) + 0 AS ic_high FROM ic",
    "ic_summary": _IC + "SELECT round(avg(ic), 6) + 0 AS ic, round(avg(ic_low), 6) + 0 AS ic_low, round(avg(ic_high), 6) + 0 AS ic_high, round(avg(ic) / stddev_samp(ic) * sqrt(12), 6) + 0 AS icir FROM ic",
    "groups": "SELECT date, code, round(ret, 6) + 0 AS ret, round(fac, 6) AS fac, grp FROM grp",
    "group_returns": "SELECT date, grp, round(avg(ret), 6) + 0 AS ret FROM grp GROUP BY 1, 2",
    "long_short": _LEGS + """SELECT date, round(long, 6) + 0 AS long, round(short, 6) + 0 AS short, round(market, 6) + 0 AS market, round(long - short, 6) + 0 AS ls, round(long - market, 6) + 0 AS inner_long, round(market - short, 6) + 0 AS inner_short,
round(sum(long - short) OVER (ORDER BY date), 6) + 0 AS net, round(sum(long - market) OVER (ORDER BY date), 6) + 0 AS net_long FROM ls""",
    "long_short_stats": _LEGS + """, z AS (SELECT long - short AS x FROM ls UNION ALL SELECT 0) SELECT round(sum(x) * 12 / count(*), 6) + 0 AS annual_ret, round((SELECT stddev_pop(long - short) FROM ls) * sqrt(12), 6) AS vol, round(sum(x) * 12 / count(*) / ((SELECT stddev_pop(long - short) FROM ls) * sqrt(12)), 6) + 0 AS ir,
(SELECT round(sum(long - market) * 12 / (count(*) + 1), 6) + 0 FROM ls) AS inner_long, (SELECT round(sum(market - short) * 12 / (count(*) + 1), 6) + 0 FROM ls) AS inner_short FROM z""",
    "group_summary": "SELECT grp, round((avg(ret) - (SELECT avg(ret) FROM grp)) * 12, 6) + 0 AS excess FROM grp GROUP BY 1",
    "factor_coverage": _COVER("amount", "grid") + "SELECT round(c, 6) AS coverage, round(p, 6) AS positive, round(s, 6) + 0 AS skew, round(a, 6) + 0 AS autocorr FROM ca",
    "factor_signs": """, chg AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), sg AS (SELECT date, code, ret AS f FROM chg WHERE ret IS NOT NULL AND code::INT % 3 <> 0),
sgd AS (SELECT sg.*, didx FROM sg JOIN (SELECT date, row_number() OVER (ORDER BY date) AS didx FROM (SELECT DISTINCT date FROM sg)) USING (date))""" + _COVER("f", "sgd") + "SELECT round(c, 6) AS coverage, round(p, 6) AS positive, round(s, 6) + 0 AS skew, round(a, 6) + 0 AS autocorr FROM ca",
    "weekly_backtest": """, wo AS (SELECT code, (date_trunc('week', date) + INTERVAL 6 DAY)::DATE AS date, arg_min(open, date) AS open FROM idx GROUP BY 1, 2), wf AS (SELECT code, (date_trunc('week', date) + INTERVAL 6 DAY)::DATE AS date, arg_max(close / open, date) AS fac FROM idx WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-20' GROUP BY 1, 2),
wr1 AS (SELECT code, date, open / nullif(max(open) OVER (PARTITION BY code ORDER BY d RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1 AS ret FROM wo JOIN (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM wo)) USING (date)),
wf1 AS (SELECT code, date, max(fac) OVER (PARTITION BY code ORDER BY d RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fac FROM wf JOIN (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM wf)) USING (date)),
wp AS (SELECT date, code, ret, fac FROM wr1 JOIN wf1 USING (date, code)),
wr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY fac, code) AS rn, count(*) OVER (PARTITION BY date) AS n FROM wp WHERE ret IS NOT NULL AND fac IS NOT NULL),
wl AS (SELECT date, avg(ret) FILTER (g = 1) AS f, avg(ret) FILTER (g = 3) AS l, avg(ret) AS market FROM (SELECT *, CASE WHEN round_even(n / 3, 0) = 0 THEN 3 ELSE least(3, (rn - 1) // round_even(n / 3, 0)::BIGINT + 1) END AS g FROM wr) GROUP BY 1),
ww AS (SELECT CASE WHEN sum(f - l) > 0 THEN 1 ELSE -1 END AS w FROM wl), ls AS (SELECT date, CASE WHEN w > 0 THEN f ELSE l END AS long, CASE WHEN w > 0 THEN l ELSE f END AS short, market FROM wl, ww)
SELECT date, round(long, 6) + 0 AS long, round(short, 6) + 0 AS short, round(market, 6) + 0 AS market, round(long - short, 6) + 0 AS ls, round(sum(long - short) OVER (ORDER BY date), 6) + 0 AS net FROM ls""",
    "obv": """, f AS (SELECT date, code, CASE WHEN close > pre_close THEN va WHEN close < pre_close THEN -va ELSE 0 END AS f FROM (SELECT *, vol * ((close - low) - (high - close)) / nullif(high - close, 0) AS va FROM idx))
SELECT date, code, CASE WHEN count(*) FILTER (f IS NULL) OVER w = 0 THEN round(sum(f) OVER w, 2) + 0 END AS obv FROM f WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "list_std_weighted": f"SELECT date, code, round(sqrt((0.5 * power(a - m, 2) + 0.25 * power(v - m, 2) + 2 * power(c - m, 2)) / 2.75), 6) AS fac FROM (SELECT *, (a + v + c) / 3 AS m FROM (SELECT date, code, {_Z('amount')} AS a, {_Z('vol')} AS v, {_Z('close')} AS c FROM panel))",
    "volume_levels": """SELECT date, code, round(sum(u) OVER w, 6) + 0 AS pvi, round(sum(d) OVER w, 6) + 0 AS nvi FROM (SELECT date, code, CASE WHEN vol > lag(vol) OVER v THEN ln(1 + pct_change) ELSE 0 END AS u, CASE WHEN vol < lag(vol) OVER v THEN ln(1 + pct_change) ELSE 0 END AS d FROM idx WINDOW v AS (PARTITION BY code ORDER BY date)) WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "pvi": """SELECT date, code, round(1000 * exp(sum(l) OVER (PARTITION BY code ORDER BY date)), 6) AS value FROM (SELECT date, code, CASE WHEN vol > lag(vol) OVER (PARTITION BY code ORDER BY date) THEN ln(1 + pct_change) ELSE 0 END AS l FROM tame)""",
    "nvi_reset": """, h AS (SELECT date, code, coalesce(vol < lag(vol) OVER (PARTITION BY code ORDER BY date), FALSE) AS hit, pct_change FROM tame), r AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY code ORDER BY date) AS run FROM h)
SELECT date, code, round(1000 * exp(sum(CASE WHEN hit THEN ln(1 + pct_change) ELSE 0 END) OVER (PARTITION BY code, run ORDER BY date)), 6) AS value FROM r""",
    "wma_momentum": f""", x AS (SELECT date, code, close, {_WMA} AS wma FROM idx WINDOW w AS (PARTITION BY code ORDER BY date)), y AS (SELECT *, wma - lag(wma, 10) OVER (PARTITION BY code ORDER BY date) AS m, {_AVG('close', 5)} < {_AVG('close', 90)} AS t FROM x)
SELECT date, code, round(wma, 6) + 0 AS wma, round(m, 6) + 0 AS momentum, coalesce(m < 0 AND t, FALSE) AS short FROM y""",
    "down_filter": f""", x AS (SELECT date, code, {_WMA} AS wma FROM idx WINDOW w AS (PARTITION BY code ORDER BY date)), y AS (SELECT *, wma - lag(wma, 10) OVER w AS m, abs(wma - lag(wma) OVER w) AS st FROM x WINDOW w AS (PARTITION BY code ORDER BY date)),
z AS (SELECT *, abs(m) / nullif(CASE WHEN count(st) OVER w >= 10 THEN sum(st) OVER w END, 0) * 100 AS e FROM y WINDOW w AS (PARTITION BY code ORDER BY date ROWS 9 PRECEDING)) SELECT date, code, round(e, 6) + 0 AS efficiency, CASE WHEN e > 50 AND m < 0 THEN 0 ELSE 1 END AS status FROM z""",
    "ema_trend": _SHORT + "SELECT date, code, round(t, 6) AS trend, round(g, 6) AS accelerator, short, long FROM trend",
    "resonance": _SHORT + _RESONANCE + "SELECT date, code, round(p, 6) AS price_energy, round(v, 6) AS volume_energy, round(x, 6) AS resonance, long FROM res",
    "combined_trend": _SHORT + _RESONANCE + "SELECT date, code, CASE WHEN rises THEN res.long OR trend.long ELSE res.long END AS combined FROM res JOIN trend USING (date, code)",
    "fwd_returns": """SELECT date, code, round(lead(open, 2) OVER w / nullif(lead(open) OVER w, 0) - 1, 6) + 0 AS ret_open, round(lead(close) OVER w / nullif(close, 0) - 1, 6) + 0 AS ret_close, round(lead(open) OVER w / nullif(close, 0) - 1, 6) + 0 AS ret_overnight,
round(lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1, 6) + 0 AS ret_inday FROM idx WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "quantile_signal": _EVENTS + "SELECT date, code, lo, so FROM ev",
    "long_only": _EVENTS + """, r AS (SELECT code, i, date, CASE WHEN lo THEN 1 ELSE 0 END AS s FROM n WHERE i = 1 UNION ALL SELECT n.code, n.i, n.date, CASE WHEN s = 1 THEN CASE WHEN so THEN 0 ELSE 1 END WHEN lo THEN 1 ELSE 0 END FROM r JOIN n ON n.code = r.code AND n.i = r.i + 1) SELECT date, code, s::INT AS signal FROM r""",
    "long_short_state": _EVENTS + """, r AS (SELECT code, i, date, CASE WHEN lo THEN 1 WHEN so THEN -1 ELSE 0 END AS s FROM n WHERE i = 1 UNION ALL
SELECT n.code, n.i, n.date, CASE WHEN s = 0 THEN CASE WHEN lo THEN 1 WHEN so THEN -1 ELSE 0 END WHEN s = 1 THEN CASE WHEN so THEN -1 ELSE 1 END ELSE CASE WHEN lo THEN 1 ELSE -1 END END FROM r JOIN n ON n.code = r.code AND n.i = r.i + 1) SELECT date, code, s::INT AS signal FROM r""",
    "mean_reversion_pos": f"SELECT date, code, round({_CLAMP('x')}, 6) + 0 AS signal FROM (SELECT date, code, (close - {_AVG('close', 252)}) / nullif({_AVG('close', 252)}, 0) AS x FROM idx)",
    "range_pos": f"""SELECT date, code, round({_CLAMP('x')}, 6) + 0 AS signal FROM (SELECT date, code, close / nullif(CASE WHEN count(close) OVER w >= 252 THEN max(close) OVER w - min(close) OVER w END, 0) - 1 AS x FROM idx WINDOW w AS (PARTITION BY code ORDER BY date ROWS 251 PRECEDING))""",
    "position_returns": f""", sg AS (SELECT date, code, coalesce({_CLAMP('x')}, 0) AS s FROM (SELECT date, code, (close - {_AVG('close', 20)}) / nullif({_AVG('close', 20)}, 0) AS x FROM idx)),
cells AS (SELECT d.date, c.code, coalesce(s, 0) AS s FROM (SELECT DISTINCT date FROM sg) d CROSS JOIN (SELECT DISTINCT code FROM sg) c LEFT JOIN sg ON sg.date = d.date AND sg.code = c.code),
po AS (SELECT date, code, s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0) AS pos FROM cells), mv AS (SELECT date, code, pos, coalesce(abs(pos - lag(pos) OVER (PARTITION BY code ORDER BY date)), 0) AS turn FROM po)
SELECT date, round(coalesce(sum(pct_change * pos - turn * 0.0002), 0), 6) + 0 AS ret FROM mv LEFT JOIN tame USING (date, code) GROUP BY 1""",
    "perf": _PERF("SELECT strategy, date, ret FROM rets"),
    "relative_perf": _PERF("SELECT strategy, date, ret - bench AS ret FROM rets"),
    "return_detail": """, nv AS (SELECT strategy, date, exp(sum(ln(1 + ret)) OVER w) AS net FROM rets WINDOW w AS (PARTITION BY strategy ORDER BY date)), dr AS (SELECT strategy, max(1 - net / top) AS md FROM (SELECT *, max(net) OVER (PARTITION BY strategy ORDER BY date) AS top FROM nv) GROUP BY 1),
x AS (SELECT strategy, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + ret)) * 250 / count(*)) - 1 AS annual, (exp(stddev_samp(ln(1 + ret))) - 1) * sqrt(250) AS sigma, exp(sum(ln(1 + ret) - ln(1 + bench))) - 1 AS excess, regr_intercept(ret, bench) * 25000 AS alpha, regr_slope(ret, bench) AS beta,
count(*) FILTER (ret >= 0) / count(*) AS win, count(*) FILTER (ret > bench) / count(*) AS ew, exp((sum(ln(1 + ret) - ln(1 + bench)) - arg_min(ln(1 + ret) - ln(1 + bench), date)) * 365 / (max(date) - min(date))) - 1 AS ea,
(exp(stddev_samp(ln(1 + ret) - ln(1 + bench))) - 1) * sqrt(250) AS es, (max(date) - min(date)) / 365 AS years, count(*) AS bars FROM rets GROUP BY 1),
en AS (SELECT strategy, date, exp(sum(ln(1 + ret) - ln(1 + bench)) OVER (PARTITION BY strategy ORDER BY date)) AS net FROM rets), ed AS (SELECT strategy, max(1 - net / top) AS ed FROM (SELECT *, max(net) OVER (PARTITION BY strategy ORDER BY date) AS top FROM en) GROUP BY 1)
SELECT strategy, round(ea, 6) + 0 AS excess_annual, round(es, 6) AS excess_sigma, round(ea / es, 6) + 0 AS excess_sharpe, round(ed, 6) AS excess_drawdown, round(years, 6) AS years, bars, round(total, 6) + 0 AS total, round(annual, 6) + 0 AS annual, round(sigma, 6) AS sigma, round(excess, 6) + 0 AS excess, round(alpha, 6) + 0 AS alpha, round(beta, 6) + 0 AS beta, round(win, 6) AS win, round(ew, 6) AS excess_win, round(md, 6) AS max_drawdown, round((annual - 0.02) / sigma, 6) + 0 AS sharpe, round(annual / md, 6) + 0 AS calmar FROM x JOIN dr USING (strategy) JOIN ed USING (strategy)""",
    "runs_test": f""", u AS (SELECT *, ret > 0 AS up, coalesce(((ret > 0) <> lag(ret > 0) OVER (PARTITION BY strategy ORDER BY date))::INT, 1) AS turn FROM rets), c AS (SELECT strategy, sum(turn)::DOUBLE AS runs, count(*) FILTER (up)::DOUBLE AS a, count(*) FILTER (NOT up)::DOUBLE AS b FROM u GROUP BY 1),
m AS (SELECT *, a + b AS n, 2 * a * b / (a + b) + 1 AS mu FROM c), z AS (SELECT strategy, (CASE WHEN n < 50 THEN sign(runs - mu) * greatest(abs(runs - mu) - 0.5, 0) ELSE runs - mu END) / sqrt((mu - 1) * (mu - 2) / (n - 1)) AS z FROM m)
SELECT strategy, round(z, 6) + 0 AS z, round(2 * (1 - {_N('abs(z)')}), 6) + 0 AS p FROM z""",
    "monthly": "SELECT strategy, date_trunc('month', date)::DATE AS period, round((exp(sum(ln(1 + ret))) - 1) * 100, 6) + 0 AS ret FROM rets GROUP BY 1, 2",
    "yearly": "SELECT strategy, year(date)::INT AS period, round((exp(sum(ln(1 + ret))) - 1) * 100, 6) + 0 AS ret, round((exp(sum(ln(1 + bench))) - 1) * 100, 6) + 0 AS bench FROM rets GROUP BY 1, 2",
    "drawdown": """SELECT strategy, date, round(1 - net / max(net) OVER w, 6) + 0 AS drawdown FROM (SELECT strategy, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS net FROM rets) WINDOW w AS (PARTITION BY strategy ORDER BY date)""",
    "rolling_sharpe": """SELECT strategy, date, CASE WHEN count(ret) OVER w >= 35 THEN round(avg(ret - 0.02 / 250) OVER w / nullif(stddev_samp(ret - 0.02 / 250) OVER w, 0), 6) + 0 END AS sharpe FROM rets WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS 34 PRECEDING)""",
    "rolling_returns": """SELECT strategy, date, round(net / lag(net, 125) OVER w - 1, 6) + 0 AS half, round(net / lag(net, 250) OVER w - 1, 6) + 0 AS year FROM (SELECT strategy, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS net FROM rets) WINDOW w AS (PARTITION BY strategy ORDER BY date)""",
    "market_effect": _EFFECT + "SELECT date, pos, neg, effect::INT AS effect FROM eff",
    "greeks": "SELECT opt_id, round(delta, 6) + 0 AS delta, round(gamma, 6) + 0 AS gamma, round(vega, 6) + 0 AS vega, round(theta, 6) + 0 AS theta FROM gr",
    "share_equivalents": "SELECT book, round(sum(delta * contracts * multiplier), 3) + 0 AS sep, round(sum(delta * contracts), 3) + 0 AS delta, round(sum(gamma * contracts), 3) + 0 AS gamma, round(sum(vega * contracts), 3) + 0 AS vega, round(sum(theta * contracts), 3) + 0 AS theta FROM gr GROUP BY 1",
    "risk_limits": "SELECT book, abs(sep) > 0.05 AS rebalance, abs(sep) > 5000 AS hedge, abs(sep) > 200000 AS delta_over, abs(g) > 0.05 AS gamma_over FROM (SELECT book, sum(delta * contracts * multiplier) AS sep, sum(gamma * contracts) AS g FROM gr GROUP BY 1)",
    "calendar_spread": f""", s AS (SELECT n.opt_id // 4 * 2 + n.opt_id % 2 AS pair, f.theta - n.theta AS nt, f.vega - n.vega AS nv, n.v, abs(n.theta / nullif(f.theta, 0)) - 1 AS twr
FROM gr n JOIN gr f ON n.opt_id // 4 = f.opt_id // 4 AND n.opt_id % 2 = f.opt_id % 2 WHERE n.opt_id % 4 < 2 AND f.opt_id % 4 >= 2)
SELECT pair, round(nt, 6) + 0 AS net_theta, round(nv, 6) + 0 AS net_vega, {_DIGITS('twr', 'twr')}, CASE WHEN twr IS NOT NULL THEN twr >= 1 AND v <= 0.4 END AS enter, twr < 0.5 AS leave FROM s""",
    "account_sim": _ONE_ACCOUNT + "SELECT date, key AS code, round(e, 6) AS equity, shares FROM eq",
    "account_stats": _ONE_ACCOUNT + f"SELECT key AS code, {_STATS} FROM st LEFT JOIN tt USING (key)",
    "grid_search": _EFFECT.split("eff AS")[0] + "gr2 AS (SELECT unnest([10, 10, 20, 20, 30, 30]) AS pos_num, unnest([15, 25, 15, 25, 15, 25]) AS neg_num)" + _MONTHS + _ACCOUNT(f"""SELECT code || ' ' || pos_num || ' ' || neg_num AS key, date, open, close, {_SIGNAL} AS signal FROM (
SELECT *, CASE WHEN pos > pos_num THEN 1 WHEN neg > neg_num THEN -1 ELSE 0 END AS effect FROM mas CROSS JOIN gr2 LEFT JOIN cnt USING (date))""") + f"""SELECT code, pos_num, neg_num, {_STATS}, row_number() OVER (PARTITION BY code ORDER BY total DESC, pos_num, neg_num) = 1 AS best
FROM (SELECT *, split_part(key, ' ', 1) AS code, split_part(key, ' ', 2)::INT AS pos_num, split_part(key, ' ', 3)::INT AS neg_num FROM st) LEFT JOIN tt USING (key)""",
    "effect_signals": _EFFECT + _MONTHS + f"SELECT date, code, round(ma, 6) AS ma, effect::INT AS effect, ({_SIGNAL})::INT AS signal FROM mas LEFT JOIN eff USING (date)",
    "trade_dates": "SELECT DISTINCT date AS cal_date FROM idx WHERE isodow(date) < 6 AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "read_daily_days": "SELECT date, code, round(close, 6) AS close FROM idx WHERE isodow(date) < 6 AND date BETWEEN DATE '1994-02-01' AND DATE '1997-06-30'",
    "read_open_monthly": "SELECT last_day(date) AS date, code, round(arg_min(open, idx.date), 6) AS open FROM idx WHERE isodow(date) < 6 GROUP BY 1, 2",
    "industry_spells": "SELECT s_suppkey::VARCHAR AS code, s_nationkey::VARCHAR AS industry, DATE '1992-01-01' AS in_date, NULL::DATE AS out_date FROM supplier",
    "status_table": "SELECT date, code, (month(date) % 2)::INT AS status FROM fac WHERE (code::INT + month(date)) % 7 = 0 AND date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'",
    "index_window": "SELECT date, round(close, 6) AS close, round(vol, 6) AS vol FROM idx WHERE code = 'A' AND date BETWEEN DATE '1993-01-01' AND DATE '1994-12-31'",
    "index_bars": "SELECT date, code, round(close, 6) AS close, round(vol, 6) AS vol, round(pre_close, 6) AS pre_close, round(close / pre_close - 1, 6) + 0 AS pct_change FROM idx",
    "last_export": "SELECT l_shipdate::DATE AS date, l_returnflag AS code, round(arg_max(l_extendedprice, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey), 6) AS price FROM lineitem GROUP BY 1, 2",
    "incremental_rows": "SELECT date, code, round(close, 6) AS close FROM idx WHERE date > (SELECT max(date) FROM idx WHERE date < DATE '1997-01-01') AND code <> 'N' AND date <> DATE '1997-03-03'",
    "stock_lists": "SELECT s_suppkey::VARCHAR AS code, CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status, CASE WHEN s_acctbal >= 0 THEN TRUE END AS active FROM supplier",
    "main_boards": "SELECT date, code, round(fac, 6) AS fac FROM fac WHERE code[1] IN ('0', '3', '6')",
    "tradable_pool": """, m AS (SELECT date, code, CASE WHEN month(date) % 2 = 0 AND ((code::INT + month(date)) % 7 = 0 OR (code::INT + month(date)) % 11 = 0 OR (code::INT + month(date)) % 13 = 0) THEN NULL ELSE fac END AS fac FROM fac f
WHERE f.code NOT IN (SELECT code FROM attr WHERE (CASE WHEN circ_mv < 0 THEN DATE '1998-06-01' ELSE DATE '1990-01-01' END) + 365 > (SELECT max(date) FROM fac))), g AS (SELECT m.*, d FROM m JOIN (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM m)) USING (date))
SELECT date, code, round(CASE WHEN count(fac) OVER w >= 3 THEN avg(fac) OVER w END, 6) + 0 AS fac FROM g WINDOW w AS (PARTITION BY code ORDER BY d RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "missing_cells": "SELECT 'panel' AS side, bool_or(fac IS NULL) AS missing FROM fac UNION ALL SELECT 'grid', count(*) < (SELECT count(DISTINCT date) * count(DISTINCT code) FROM fac) FROM fac",
    "common_keys": "SELECT date, code, round(fac, 6) AS fac, unnest(['a', 'b']) AS side FROM fac WHERE code::INT % 3 <> 0 AND code::INT % 2 = 0",
    "first_of_panels": "SELECT date, code, round(CASE WHEN code::INT % 2 = 0 THEN amount ELSE vol END, 6) AS fac FROM panel WHERE code::INT % 2 = 0 OR code::INT % 3 = 0",
    "first_rows": "SELECT code, min(date) AS date, round(arg_min(close, panel.date), 6) AS close FROM panel GROUP BY 1",
    "column_rules": """, j AS (SELECT date, arg_max(close, code) - arg_min(close, code) AS j FROM panel GROUP BY 1), c AS (SELECT *, lpad(code, 6, '0') AS full_code FROM panel JOIN j USING (date))
SELECT date, full_code || CASE WHEN full_code[1] IN ('0', '3') THEN '.SZ' WHEN full_code[1] = '6' THEN '.SH' WHEN full_code[1] = '8' THEN '.BJ' ELSE '' END AS code, printf('%.1f%%', round(vol / 64) / 8 * 100) AS pct, round(greatest(vol, close), 6) AS high, round(least(vol, close), 6) AS low,
round(CASE WHEN close > 1500 THEN amount WHEN close < 1500 THEN vol ELSE 0 END, 6) AS own_pick, round(CASE WHEN j > 0 THEN amount WHEN j < 0 THEN vol ELSE 0 END, 6) AS market_pick FROM c""",
    "list_cells": "SELECT date, code, round(close, 6) AS last, NULL::DOUBLE AS none, unnest([0, 1, 2])::INT AS n, round(unnest([amount, vol, close]), 6) AS fac FROM panel",
    "half_life": "SELECT r_regionkey AS k, i::INT AS place, round(power(0.5, (7 - i) / 3.0) / (SELECT sum(power(0.5, x / 3.0)) FROM range(8) t(x)), 6) AS weight FROM region, range(8) t(i)",
    "weighted_std": "SELECT date, round(sqrt(sum(vol * power(close - m, 2)) / sum(vol)), 6) AS fac FROM panel JOIN (SELECT date, avg(close) AS m FROM panel GROUP BY 1) USING (date) GROUP BY 1",
    "distance_mean": "SELECT date, code, round(power(fac / 1000 - m, 2), 6) AS fac FROM fac JOIN (SELECT date, avg(fac / 1000) AS m FROM fac GROUP BY 1) USING (date)",
    "level_signal": """, n AS (SELECT date, code, x >= 1.03 AS lo, x <= 0.97 AS so, vol <= 300 AS sc, vol >= 600 AS lc, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM (SELECT *, round(close / open, 6) AS x FROM idx)),
r AS (SELECT code, i, date, CASE WHEN lo THEN 1 WHEN so THEN -1 ELSE 0 END AS s FROM n WHERE i = 1 UNION ALL SELECT n.code, n.i, n.date, CASE s WHEN 0 THEN CASE WHEN lo THEN 1 WHEN so THEN -1 ELSE 0 END WHEN 1 THEN CASE WHEN lc THEN CASE WHEN so THEN -1 ELSE 0 END ELSE 1 END
ELSE CASE WHEN sc THEN CASE WHEN lo THEN 1 ELSE 0 END ELSE -1 END END FROM r JOIN n ON n.code = r.code AND n.i = r.i + 1) SELECT date, code, s::INT AS signal FROM r WHERE date >= DATE '1995-01-01'""",
    "next_shipment": """SELECT o.code, o.date, o_orderstatus, s.date AS next_date, round(quantity, 6) AS quantity FROM (SELECT o_orderkey AS code, o_orderdate::DATE AS date, o_orderstatus FROM orders) o
ASOF LEFT JOIN (SELECT l_orderkey AS code, l_shipdate::DATE AS date, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) s ON o.code = s.code AND o.date < s.date""",
    "next_exit": """, en AS (SELECT code, date, close FROM idx WHERE round(close / open, 6) >= 1.03), pl AS (SELECT o_orderdate::DATE AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'R' END AS code, count(*) AS placed FROM orders GROUP BY 1, 2),
ex AS (SELECT * FROM (SELECT *, avg(placed) OVER (PARTITION BY code) AS u FROM pl) WHERE placed > 2 * u) SELECT en.code, en.date, round(close, 6) AS close, ex.date AS next_date, placed FROM en ASOF LEFT JOIN ex ON en.code = ex.code AND en.date <= ex.date""",
    "level_long": """, n AS (SELECT date, code, x >= 1.03 AS lo, x <= 0.97 AS so, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM (SELECT *, round(close / open, 6) AS x FROM idx)),
r AS (SELECT code, i, date, CASE WHEN lo THEN 1 ELSE 0 END AS s FROM n WHERE i = 1 UNION ALL SELECT n.code, n.i, n.date, CASE WHEN s = 1 THEN CASE WHEN so THEN 0 ELSE 1 END WHEN lo THEN 1 ELSE 0 END FROM r JOIN n ON n.code = r.code AND n.i = r.i + 1) SELECT date, code, s::INT AS signal FROM r""",
    "group_nets": """, e AS (SELECT date, grp, avg(ret) AS ret FROM grp GROUP BY 1, 2 UNION ALL SELECT (SELECT min(date) - INTERVAL 1 MONTH FROM grp)::DATE, grp, 0 FROM grp GROUP BY grp) SELECT date, grp, round(ret, 6) + 0 AS ret, round(sum(ret) OVER (PARTITION BY grp ORDER BY date), 6) + 0 AS net FROM e""",
    "long_against_index": _LEGS + _BENCH + "SELECT date, round(long - b, 6) + 0 AS long_minus_index, round(sum(long - b) OVER (ORDER BY date), 6) + 0 AS net_index FROM ls LEFT JOIN bm USING (date)",
    "long_side_by_year": _LEGS + "SELECT year(date)::INT AS year, round(avg(CASE WHEN (SELECT avg(f) > avg(l) FROM legs) THEN f ELSE l END) * 12, 6) + 0 AS ret FROM legs GROUP BY 1",
    "relative_to_index": """, mr AS (SELECT strategy, last_day(date) AS date, exp(sum(ln(1 + ret))) - 1 AS r FROM rets GROUP BY 1, 2), ix AS (SELECT date, c / nullif(lag(c) OVER (ORDER BY date), 0) - 1 AS i FROM (SELECT last_day(date) AS date, arg_max(close, idx.date) AS c FROM idx WHERE code = 'N' GROUP BY 1)),
ex AS (SELECT strategy, date, r - i AS ret FROM mr JOIN ix USING (date) WHERE i IS NOT NULL)""" + _PERF("SELECT * FROM ex UNION ALL SELECT strategy, (min(date) - INTERVAL 1 MONTH)::DATE, 0 FROM ex GROUP BY 1").replace("sqrt(252)", "sqrt(12)"),
    "excess_detail": """, x AS (SELECT *, ln(1 + ret) - ln(1 + bench) AS o FROM rets), t AS (SELECT strategy, exp((sum(o) - arg_min(o, date)) * 365 / (max(date) - min(date))) - 1 AS ea, (exp(stddev_samp(o)) - 1) * sqrt(250) AS es, (max(date) - min(date)) / 365 AS years, count(*) AS bars FROM x GROUP BY 1),
n AS (SELECT strategy, date, exp(sum(o) OVER (PARTITION BY strategy ORDER BY date)) AS net FROM x), d AS (SELECT strategy, max(1 - net / top) AS ed FROM (SELECT *, max(net) OVER (PARTITION BY strategy ORDER BY date) AS top FROM n) GROUP BY 1)
SELECT strategy, round(ea, 6) + 0 AS excess_annual, round(es, 6) AS excess_sigma, round(ea / es, 6) + 0 AS excess_sharpe, round(ed, 6) AS excess_drawdown, round(years, 6) AS years, bars FROM t JOIN d USING (strategy)""",
    "sub_period": """, r AS (SELECT * FROM rets WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'), n AS (SELECT strategy, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS net FROM r), d AS (SELECT strategy, max(1 - net / top) AS md FROM (SELECT *, max(net) OVER (PARTITION BY strategy ORDER BY date) AS top FROM n) GROUP BY 1),
t AS (SELECT strategy, exp(sum(ln(1 + ret)) * 250 / count(*)) - 1 AS a, (exp(stddev_samp(ln(1 + ret))) - 1) * sqrt(250) AS s FROM r GROUP BY 1) SELECT strategy, round(a, 6) + 0 AS annual, round(s, 6) AS sigma, round((a - 0.02) / s, 6) + 0 AS sharpe, round(md, 6) AS max_drawdown FROM t JOIN d USING (strategy)""",
    "rolling_sharpes": "SELECT strategy, date, " + ", ".join(f"CASE WHEN count(l) OVER w{n} >= {n} THEN round((exp(avg(l) OVER w{n} * 250) - 1) / nullif((exp(stddev_samp(l) OVER w{n}) - 1) * sqrt(250), 0), 6) + 0 END AS {name}" for name, n in (("half", 125), ("year", 250))) + " FROM (SELECT strategy, date, ln(1 + ret) AS l FROM rets) WINDOW w125 AS (PARTITION BY strategy ORDER BY date ROWS 124 PRECEDING), w250 AS (PARTITION BY strategy ORDER BY date ROWS 249 PRECEDING)",
    "period_sums": "SELECT strategy, date_trunc('month', date)::DATE AS period, round(sum(ret), 6) + 0 AS total, round((exp(sum(ret)) - 1) * 100, 6) + 0 AS log_total, round(product(1 + ret), 6) AS product FROM rets GROUP BY 1, 2",
    "start_zero": "SELECT strategy, date, round(ret, 6) + 0 AS ret FROM rets UNION ALL SELECT strategy, min(date) - 7, 0 FROM rets GROUP BY 1",
    "option_values": ", " + _PRICED + "SELECT opt_id, round(delta * ds + 0.5 * gamma * ds * ds + vega * dv + theta / 252, 6) + 0 AS change, round(delta + gamma * ds, 6) + 0 AS delta_after, round(intrinsic, 6) AS intrinsic, round(intrinsic + tv - intrinsic, 6) + 0 AS time_value FROM p",
    "option_rules": ", " + _PRICED + "SELECT opt_id, floor(50000 / margin)::BIGINT AS contracts, round(theta / margin, 6) + 0 AS theta_return, abs(gamma) <= theta / (0.5 * v * v * s * s) AS covered, " + _DIGITS("(vega / nullif(abs(theta / 252), 0))", "vega_days") + " FROM p",
    "close_at_expiry": """, o AS (SELECT o_orderkey AS opt_id, o_orderdate::DATE AS day, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS expiry FROM orders), l AS (SELECT opt_id, day AS date, expiry FROM o UNION ALL SELECT opt_id, expiry, expiry FROM o)
SELECT book, expiry, count(*) AS looks, count(*) FILTER (date = expiry AND abs(s - k) <= 0.01 * k) AS closes FROM l JOIN book USING (opt_id) GROUP BY 1, 2""",
    "sell_screen": "SELECT opt_id FROM gr WHERE abs(gamma) < 2 * abs(theta) AND gamma / nullif(theta, 0) <= 5",
    "hedge_trades": "SELECT opt_id % 500 AS opt_id, DATE '1992-01-01' + (opt_id // 500)::INT AS date, round(s, 6) AS s, round(gamma, 6) + 0 AS gamma, round(-lag(gamma) OVER w * (s - lag(s) OVER w), 6) + 0 AS trade FROM gr WINDOW w AS (PARTITION BY gr.opt_id % 500 ORDER BY gr.opt_id // 500)",
    "book_in_currency": "SELECT book, round(sum(delta * contracts * multiplier) * (1 + book[1]::INT / 4), 3) + 0 AS sep FROM gr GROUP BY 1",
    "atm_concentration": """SELECT book, round(share, 6) AS share, share >= 0.3 AS over FROM (SELECT book, coalesce(sum(abs(gamma * contracts)) FILTER (abs(s / k - 1) <= 0.01), 0) / nullif(sum(abs(gamma * contracts)), 0) AS share FROM gr GROUP BY 1)""",
    "strategy_greeks": "SELECT opt_id % 1000 AS strategy, round(sum(delta * contracts), 4) + 0 AS delta, round(sum(gamma * contracts), 4) + 0 AS gamma, round(sum(vega * contracts), 4) + 0 AS vega, round(sum(theta * contracts), 4) + 0 AS theta FROM gr GROUP BY 1",
}.items()}


def _summary_of(col: str) -> str:
    """Twelve figures of one factor, which takes the place of ``amount`` as the panel's factor."""
    base = _BASE.replace("amount AS fac FROM panel", f"{col} AS fac FROM panel").replace("max(amount) OVER (PARTITION BY code ORDER BY didx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fac", f"max({col}) OVER (PARTITION BY code ORDER BY didx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fac")
    figures = """, zs AS (SELECT sum(long - short) * 12 / (count(*) + 1) AS r, stddev_pop(long - short) * sqrt(12) AS v FROM ls), ia AS (SELECT avg(ic) AS i, avg(ic_low) AS il, avg(ic_high) AS ih FROM ic),
gm AS (SELECT avg(f) AS f, avg(l) AS l FROM legs), bx AS (SELECT avg(b) AS b FROM bm WHERE date IN (SELECT date FROM fac WHERE fac IS NOT NULL))"""
    return base + _LEGS + _IC + _BENCH + figures + _COVER(col, "grid") + f"""SELECT '{col}' AS factor_name, unnest(['ic', 'annual_ret', 'vol', 'ir', 'positive', 'skew', 'autocorr', 'coverage', 'ic_low', 'ic_high', 'first_excess', 'last_excess']) AS metric,
round(unnest([i, r, v, r / v, p, s, a, c, il, ih, (f - b) * 12, (l - b) * 12]), 6) + 0 AS value FROM zs, ia, ca, gm, bx"""


ORACLE["factor_summary"] = f"SELECT metric, value FROM ({_summary_of('amount')})"
ORACLE["factor_summaries"] = f"SELECT * FROM ({_summary_of('amount')}) UNION ALL SELECT * FROM ({_summary_of('vol')})"

#: Every built-in factor's rows, from the queries that give them by themselves.
ORACLE["all_factors"] = " UNION ALL ".join(
    [f"SELECT date, code, '{prefix}' || factor_name AS factor_name, fac FROM (SELECT * FROM ({ORACLE[name]})) UNPIVOT INCLUDE NULLS (fac FOR factor_name IN (COLUMNS(* EXCLUDE (date, code))))" for name, prefix in (("pv_returns", ""), ("pv_volume", ""), ("pv_bars15", ""), ("pv_vov", ""), ("reverse_m", "reverse_"))]
    + [f"SELECT date, code, 'smart_' || score AS factor_name, q AS fac FROM ({ORACLE['smart_money']})"]
)
