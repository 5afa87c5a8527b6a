"""The registered queries of the panel engine: each takes (spark, sf_dir), and rounds what is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import columns, registry
from gridloom.functions.columns import ratio, steady
from gridloom.operators import cross, evaluation, intraday, options, returns, series, timing
from gridloom.sources import readers, views
from gridloom.sources.kept import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLACES = 6


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(spark, sf_dir)
        # Adding 0.0 makes a negative zero a plain one.
        return out.select(*[(steady(F.col(c), PLACES) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def _factor(spark: SparkSession, sf: str) -> DataFrame:
    return views.panel(spark, sf).select("date", "code", F.col("amount").alias("fac"))


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return views.panel(spark, sf).select("date", "code", "amount", "vol", "close")


def _with_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return _factor(spark, sf).join(views.attributes(spark, sf), "code").select("date", "code", "fac", "industry", "circ_mv")


@query
def read_daily_weekly(spark, sf):
    return readers.read_daily(views.index_daily(spark, sf), "close", freq="W")


@query
def read_market_monthly(spark, sf):
    return readers.read_market(views.index_daily(spark, sf), "close", "N", freq="M")


@query
def high_water_mark(spark, sf):
    daily = views.index_daily(spark, sf)
    expected = daily.select("date").distinct().withColumn("n", F.lit(2))
    return readers.complete_until(daily, expected)


@query
def tradable_mask(spark, sf):
    panel = _factor(spark, sf)
    attr = views.attributes(spark, sf)
    status = panel.select("date", "code").filter("(cast(code as int) + month(date)) % 7 = 0").withColumn("status", F.when(F.month("date") % 2 == 0, 0).otherwise(1))
    listing = attr.select("code", F.when(F.col("circ_mv") < 0, F.to_date(F.lit("1998-06-01"))).otherwise(F.to_date(F.lit("1990-01-01"))).alias("list_date"))
    return cross.mask_status(cross.without_new(panel, listing), status)


@query
def zscore(spark, sf):
    return cross.zscore(_factor(spark, sf))


@query
def zscore_all_pos(spark, sf):
    return cross.zscore(_factor(spark, sf), all_pos=True)


@query
def clip_mad_replace(spark, sf):
    return cross.clip_mad(_factor(spark, sf), 2.0)


@query
def clip_mad_null(spark, sf):
    return cross.clip_mad(_factor(spark, sf), 2.0, "null")


@query
def clip_mad_trend(spark, sf):
    return cross.clip_mad(_factor(spark, sf), 2.0, "trend")


@query
def clip_sigma(spark, sf):
    return cross.clip_sigma(_factor(spark, sf), 2.0)


@query
def clip_pct(spark, sf):
    return cross.clip_percentile(_factor(spark, sf))


@query
def qcut_group(spark, sf):
    return cross.quantile_group(_factor(spark, sf), 10)


@query
def abs_dist(spark, sf):
    return cross.distance(_factor(spark, sf), 0.5)


@query
def coin_reverse(spark, sf):
    x = _three(spark, sf).withColumn("ret", ratio(F.col("close"), series.lagged("close")) - 1).filter("ret is not null")
    return cross.coin_reverse(x.select("date", "code", "ret", "vol"), "ret", "vol").select("date", "code", "fac")


@query
def coin_reverse_split(spark, sf):
    x = _three(spark, sf).withColumn("ret", ratio(F.col("close"), series.lagged("close")) - 1).filter("ret is not null")
    return cross.coin_reverse(x.select("date", "code", "ret", "vol"), "ret", "vol", mean=False, split=True).select("date", "code", "fac")


@query
def add_zscores(spark, sf):
    return cross.add_zscores(_three(spark, sf), ["amount", "vol"]).select("date", "code", "fac")


@query
def neutral_size(spark, sf):
    return cross.neutralise_size(_with_attributes(spark, sf)).select("date", "code", steady(F.col("fac"), 3).alias("fac"))


@query
def neutral_industry(spark, sf):
    return cross.neutralise_industry(_with_attributes(spark, sf)).select("date", "code", "fac")


@query
def preprocess_pipeline(spark, sf):
    return cross.preprocess(_with_attributes(spark, sf)).select("date", "code", "fac")


@query
def cs_corr(spark, sf):
    return cross.correlation(_three(spark, sf), "amount", "close", method="spearman")


@query
def cs_corr_kendall(spark, sf):
    return cross.correlation(_three(spark, sf), "amount", "close", method="kendall")


@query
def ts_corr(spark, sf):
    return cross.correlation(_three(spark, sf), "amount", "close", key="code")


@query
def corr_matrix(spark, sf):
    return cross.correlation_matrix(_three(spark, sf), ["amount", "vol", "close"])


@query
def merge_many(spark, sf):
    long = intraday.union_factors([_three(spark, sf).select("date", "code", c) for c in ("amount", "vol", "close")])
    return cross.merge_factors(long, ["amount", "vol", "close"])


@query
def list_std(spark, sf):
    x = _three(spark, sf)
    z = x.withColumns({c: cross.z_of(F.col(c)) for c in ("amount", "vol", "close")})
    return cross.factors_std(z, ["amount", "vol", "close"]).select("date", "code", "fac")


@query
def list_std_weighted(spark, sf):
    x = _three(spark, sf)
    z = x.withColumns({c: cross.z_of(F.col(c)) for c in ("amount", "vol", "close")})
    return cross.factors_std(z, ["amount", "vol", "close"], [0.5, 0.25, 2.0]).select("date", "code", "fac")


@query
def smooth_daily(spark, sf):
    return series.smooth(_factor(spark, sf), 6)


@query
def smooth_weekly(spark, sf):
    return series.smooth(views.index_daily(spark, sf).select("date", "code", F.col("close").alias("fac")), 20, weekly=True)


@query
def vov(spark, sf):
    return series.volatility_of_z(_factor(spark, sf), 12, 6)


@query
def interval_expand(spark, sf):
    orders = views.table(spark, sf, "orders")
    entry = F.to_date("o_orderdate")
    # A code has one row a kind and day, so codes are counted without grouping the days by code.
    return cross.expand_membership(orders.select(F.col("o_custkey").cast("string").alias("code"), F.col("o_orderpriority").alias("kind"), entry.alias("entry"), F.when(F.col("o_orderstatus") != "P", F.date_add(entry, 20)).alias("exit")), "1998-12-31").groupBy("kind", "date").agg(F.count("*").alias("members"), F.count("code").alias("codes"))


@query
def pv_returns(spark, sf):
    return intraday.return_factors(views.bars(spark, sf))


@query
def pv_volume(spark, sf):
    return intraday.volume_factors(views.bars(spark, sf))


@query
def pv_bars15(spark, sf):
    return intraday.bucket_factors(views.bars(spark, sf))


@query
def pv_vov(spark, sf):
    return intraday.volatility_factors(views.bars(spark, sf))


@query
def smart_money(spark, sf):
    return intraday.smart_money(views.bars(spark, sf))


@query
def reverse_m(spark, sf):
    b = views.bars(spark, sf)
    return intraday.reverse_momentum(b, intraday.day_returns(b))


def _pairs(spark, sf):
    return evaluation.paired(_factor(spark, sf), evaluation.period_returns(views.panel(spark, sf)))


@query
def rank_ic(spark, sf):
    return evaluation.rank_ic(_pairs(spark, sf))


@query
def ic_summary(spark, sf):
    return evaluation.ic_summary(evaluation.rank_ic(_pairs(spark, sf)), 12)


@query
def groups(spark, sf):
    return evaluation.equal_groups(_pairs(spark, sf), 5)


@query
def group_returns(spark, sf):
    return evaluation.group_returns(evaluation.equal_groups(_pairs(spark, sf), 5))


@query
def long_short(spark, sf):
    return evaluation.evaluate(_factor(spark, sf), views.panel(spark, sf), 5)


@query
def long_short_stats(spark, sf):
    return evaluation.long_short_stats(evaluation.evaluate(_factor(spark, sf), views.panel(spark, sf), 5), 12)


@query
def group_summary(spark, sf):
    return evaluation.group_summary(evaluation.equal_groups(_pairs(spark, sf), 5), 12)


@query
def factor_coverage(spark, sf):
    return evaluation.coverage(_factor(spark, sf), views.panel(spark, sf))


@query
def factor_signs(spark, sf):
    # A factor of both signs, without a third of the codes and the first month.
    x = views.panel(spark, sf)
    change = x.select("date", "code", (ratio(F.col("close"), series.lagged("close")) - 1).alias("fac")).filter("fac is not null and cast(code as int) % 3 <> 0")
    return evaluation.coverage(change, x)


@query
def weekly_backtest(spark, sf):
    daily = views.index_daily(spark, sf)
    out = evaluation.evaluate(daily.select("date", "code", ratio(F.col("close"), F.col("open")).alias("fac")), daily, 3, freq="W", start="1993-01-01", end="1997-12-20")
    return out.select("date", "long", "short", "market", "ls", "net")


@query
def obv(spark, sf):
    return series.money_flow_line(views.index_daily(spark, sf)).select("date", "code", steady(F.col("obv"), 2).alias("obv"))


@query
def pvi(spark, sf):
    return series.volume_index(_tame(spark, sf), True).select("date", "code", "value")


@query
def volume_levels(spark, sf):
    """Logarithms of both volume indices on the returns as they are."""
    daily = views.index_daily(spark, sf)
    both = series.volume_index(series.volume_index(daily, True, out="pvi"), False, out="nvi")
    return both.select("date", "code", *[F.ln(F.col(c) / 1000).alias(c) for c in ("pvi", "nvi")])


@query
def nvi_reset(spark, sf):
    return series.volume_index(_tame(spark, sf), False, reset=True).select("date", "code", "value")


def _tame(spark, sf):
    return views.index_daily(spark, sf).withColumn("pct_change", views.tame(F.col("pct_change")))


@query
def wma_momentum(spark, sf):
    return series.short_state(views.index_daily(spark, sf)).select("date", "code", "wma", "momentum", "short")


@query
def down_filter(spark, sf):
    return series.down_market(views.index_daily(spark, sf)).select("date", "code", "efficiency", "status")


@query
def ema_trend(spark, sf):
    return series.trend_strength(views.index_daily(spark, sf)).select("date", "code", "trend", "accelerator", "short", "long")


@query
def combined_trend(spark, sf):
    return series.combined_rule(views.index_daily(spark, sf)).select("date", "code", "combined")


@query
def resonance(spark, sf):
    return series.resonance(views.index_daily(spark, sf)).select("date", "code", "price_energy", "volume_energy", "resonance", "long")


@query
def fwd_returns(spark, sf):
    return series.forward_returns(views.index_daily(spark, sf))


def _events(spark, sf):
    return timing.quantile_events(views.index_daily(spark, sf), "close")


@query
def quantile_signal(spark, sf):
    return _events(spark, sf).select("date", "code", "lo", "so")


@query
def long_only(spark, sf):
    return timing.long_signal(_events(spark, sf)).select("date", "code", "signal")


@query
def long_short_state(spark, sf):
    return timing.long_short_signal(_events(spark, sf)).select("date", "code", "signal")


@query
def mean_reversion_pos(spark, sf):
    return timing.mean_reversion(views.index_daily(spark, sf), "close").select("date", "code", "signal")


@query
def range_pos(spark, sf):
    return timing.range_position(views.index_daily(spark, sf), "close").select("date", "code", "signal")


@query
def position_returns(spark, sf):
    pos = returns.positions(timing.mean_reversion(views.index_daily(spark, sf), "close", 20).select("date", "code", "signal"))
    return returns.position_returns(pos, _tame(spark, sf).select("date", "code", F.col("pct_change").alias("ret")).filter("ret is not null"))


@query
def perf(spark, sf):
    return returns.performance(views.returns(spark, sf))


@query
def relative_perf(spark, sf):
    return returns.relative_performance(views.returns(spark, sf))


@query
def return_detail(spark, sf):
    return returns.detail(views.returns(spark, sf))


@query
def runs_test(spark, sf):
    return returns.runs_test(views.returns(spark, sf))


@query
def monthly(spark, sf):
    return returns.by_period(views.returns(spark, sf), "month")


@query
def yearly(spark, sf):
    return returns.against_benchmark(views.returns(spark, sf), "year")


@query
def drawdown(spark, sf):
    return returns.drawdown_compound(views.returns(spark, sf))


@query
def rolling_sharpe(spark, sf):
    return returns.rolling_sharpe(views.returns(spark, sf))


@query
def rolling_returns(spark, sf):
    return returns.rolling_returns(views.returns(spark, sf))


@query
def market_effect(spark, sf):
    return timing.market_effect(views.panel(spark, sf), back=3, up=0.05, down=-0.05, pos_num=20, neg_num=25)


def _account_signals(spark, sf):
    effect = timing.market_effect(views.panel(spark, sf), back=3, up=0.05, down=-0.05, pos_num=20, neg_num=25)
    months = views.index_daily(spark, sf).withColumns({"day": F.col("date"), "date": F.trunc("date", "month")}).groupBy("date", "code").agg(F.min_by("open", "day").alias("open"), F.max_by("close", "day").alias("close"))
    return timing.effect_signals(months, effect, 3)


@query
def account_sim(spark, sf):
    return timing.account(_account_signals(spark, sf)).select("date", "code", "equity", "shares")


@query
def account_stats(spark, sf):
    return timing.account_stats(_account_signals(spark, sf))


@query
def grid_search(spark, sf):
    index = _account_signals(spark, sf).select("date", "code", "open", "close")
    return timing.grid_search(index, views.panel(spark, sf), [10, 20, 30], [15, 25], window=3, back=3, up=0.05, down=-0.05)


@query
def effect_signals(spark, sf):
    return _account_signals(spark, sf).select("date", "code", "ma", "effect", "signal")


@query
def greeks(spark, sf):
    return options.greeks(views.option_book(spark, sf)).select("opt_id", "delta", "gamma", "vega", "theta")


@query
def share_equivalents(spark, sf):
    x = options.share_equivalents(options.greeks(views.option_book(spark, sf)))
    return x.select("book", *[steady(F.col(c), 3).alias(c) for c in x.columns[1:]])


@query
def risk_limits(spark, sf):
    return options.risk_flags(options.share_equivalents(options.greeks(views.option_book(spark, sf))), 1e6).select("book", "rebalance", "hedge", "delta_over", "gamma_over")


@query
def calendar_spread(spark, sf):
    x = options.greeks(views.option_book(spark, sf)).withColumn("pair", F.floor(F.col("opt_id") / 4))
    # Calls with calls (0, 2) and puts with puts (1, 3); the ratio is null where the far theta is 0.
    x = x.withColumn("pair", F.col("pair") * 2 + F.col("opt_id") % 2)
    out = options.calendar_spread(x.filter("opt_id % 4 < 2"), x.filter("opt_id % 4 >= 2"), "pair")
    return out.select("pair", "net_theta", "net_vega", *_digits("twr"), "enter", "leave")


def _digits(col: str) -> list:
    """A number of any size as digits (six places of 1 to 10) and its power of ten: a far theta near 0 gives large ratios."""
    power = F.floor(F.log10(F.when(F.abs(col) >= 1e-6, F.abs(col)).otherwise(1.0))).cast("int")
    return [(F.col(col) / F.pow(F.lit(10.0), power)).alias(col), F.when(F.col(col).isNotNull(), power).alias(f"{col}_power")]


@query
def atm_concentration(spark, sf):
    return options.atm_concentration(options.greeks(views.option_book(spark, sf)))


@query
def strategy_greeks(spark, sf):
    x = options.greeks(views.option_book(spark, sf))
    legs = x.select((F.col("opt_id") % 1000).alias("strategy"), F.when(F.col("contracts") < 0, -1).otherwise(1).alias("side"), F.abs("contracts").alias("quantity"), "delta", "gamma", "vega", "theta")
    out = options.strategy_greeks(legs)
    return out.select("strategy", *[steady(F.col(c), 4).alias(c) for c in out.columns[1:]])


@query
def boxcox(spark, sf):
    return cross.box_cox(_factor(spark, sf))


@query
def sym_orth(spark, sf):
    return cross.orthogonalise(_three(spark, sf), ["amount", "vol", "close"])


@query
def de_cross(spark, sf):
    return cross.regress_out(_three(spark, sf), "amount", ["vol", "close"]).select("date", "code", steady(F.col("fac"), 4).alias("fac"))


# Readers, masks and column functions


def _calendar(spark, sf):
    """The index bars' dates; those at the end of a week's work are closed."""
    return views.index_daily(spark, sf).select(F.col("date").alias("cal_date")).distinct().withColumn("is_open", F.weekday("cal_date") < 5)


@query
def trade_dates(spark, sf):
    return readers.trading_days(_calendar(spark, sf), "1995-01-01", "1996-12-31")


@query
def read_daily_days(spark, sf):
    return readers.read_daily(views.index_daily(spark, sf), "close", freq="D", start="1994-02-01", end="1997-06-30", calendar=_calendar(spark, sf))


@query
def read_open_monthly(spark, sf):
    return readers.read_daily(views.index_daily(spark, sf), "open", adjusted=False, freq="M", calendar=_calendar(spark, sf))


@query
def industry_spells(spark, sf):
    s = views.table(spark, sf, "supplier")
    table = s.select(F.col("s_suppkey").cast("string").alias("ts_code"), F.col("s_nationkey").cast("string").alias("l1code"), F.to_date(F.lit("1992-01-01")).alias("in_date"), F.lit(None).cast("date").alias("out_date"))
    return readers.industry_members(table)


def _status(spark, sf):
    return _factor(spark, sf).filter("(cast(code as int) + month(date)) % 7 = 0").select("date", "code", F.when(F.month("date") % 2 == 0, 0).otherwise(1).alias("status"))


@query
def status_table(spark, sf):
    return readers.status_rows(_status(spark, sf), "1994-01-01", "1995-12-31")


@query
def index_window(spark, sf):
    return readers.index_data(views.index_daily(spark, sf), "A", "1993-01-01", "1994-12-31", ["date", "close", "vol"])


@query
def index_bars(spark, sf):
    x = views.index_daily(spark, sf).withColumnsRenamed({"code": "order_book_id", "vol": "volume", "pre_close": "prev_close"}).drop("pct_change")
    return readers.index_bars(x).select("date", "code", "close", "vol", "pre_close", "pct_change")


@query
def last_export(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return readers.read_exports(li.select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("code"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("at")), "at").select("date", "code", "price")


@query
def incremental_rows(spark, sf):
    daily = views.index_daily(spark, sf).select("date", "code", "close")
    fresh = readers.new_rows(daily, daily.filter("date < '1997-01-01'"))
    return readers.without(fresh, codes=spark.createDataFrame([("N",)], "code string"), date="1997-03-03")


@query
def stock_lists(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status"))
    every = readers.all_stocks(s.filter("list_status = 'L'"), s.filter("list_status = 'D'"))
    return every.join(readers.active(every).select("code", F.lit(True).alias("active")), "code", "left")


@query
def main_boards(spark, sf):
    return cross.main_boards(_factor(spark, sf))


@query
def tradable_pool(spark, sf):
    panel, attr = _factor(spark, sf), views.attributes(spark, sf)
    listing = attr.select("code", F.when(F.col("circ_mv") < 0, F.to_date(F.lit("1998-06-01"))).otherwise(F.to_date(F.lit("1990-01-01"))).alias("list_date"))
    flag = lambda k, name: panel.filter(f"(cast(code as int) + month(date)) % {k} = 0").select("date", "code", (F.month("date") % 2).alias(name))
    return cross.tradable(panel, listing=listing, st=flag(7, "status"), suspended=flag(11, "status"), limits=flag(13, "limit_status"), smooth_days=6)


@query
def missing_cells(spark, sf):
    panel = _factor(spark, sf)
    return cross.has_missing(panel).withColumn("side", F.lit("panel")).unionByName(cross.grid_has_missing(panel).withColumn("side", F.lit("grid")))


@query
def common_keys(spark, sf):
    x = _factor(spark, sf)
    a, b = cross.common_keys([x.filter("cast(code as int) % 3 <> 0"), x.filter("cast(code as int) % 2 = 0")], "code")
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query
def first_of_panels(spark, sf):
    x = _three(spark, sf)
    a = x.filter("cast(code as int) % 2 = 0").select("date", "code", F.col("amount").alias("fac"))
    b = x.filter("cast(code as int) % 3 = 0").select("date", "code", F.col("vol").alias("fac"))
    return cross.coalesce_panels([a, b])


@query
def first_rows(spark, sf):
    return cross.first_rows(views.panel(spark, sf).select("code", "date", "close"), ["code"], "date")


@query
def column_rules(spark, sf):
    x = _three(spark, sf)
    judge = x.groupBy("date").agg((F.max_by("close", "code") - F.min_by("close", "code")).alias("judge"))
    x = columns.pick_by_market(x, judge, "amount", "vol", "market_pick")
    gap = F.col("close") - 1500
    return x.select(
        "date", columns.code_suffix(F.col("code")).alias("code"), columns.percent_text(F.round(F.col("vol") / 64) / 8).alias("pct"), columns.pair_max(F.col("vol"), F.col("close")).alias("high"), columns.pair_min(F.col("vol"), F.col("close")).alias("low"),
        columns.pick_by_sign(gap, F.col("amount"), F.col("vol")).alias("own_pick"), "market_pick",
    )


@query
def list_cells(spark, sf):
    x = cross.zip_factors(_three(spark, sf), ["amount", "vol", "close"])
    one = x.withColumn("last", columns.list_item(F.col("cells"), -1)).withColumn("none", columns.list_item(F.col("cells"), 3))
    return columns.list_cells(one)


@query
def half_life(spark, sf):
    return views.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.posexplode(columns.half_life_weights(8, 3.0)).alias("place", "weight"))


@query
def weighted_std(spark, sf):
    return cross.weighted_std(_three(spark, sf), "close", "vol")


@query
def distance_mean(spark, sf):
    return cross.distance(_factor(spark, sf).withColumn("fac", F.col("fac") / 1000), square=True)


@query
def level_signal(spark, sf):
    x = series.on_grid(views.index_daily(spark, sf)).withColumns({"fac": steady(F.col("close") / F.col("open"), 6), "other": F.col("vol")})
    return timing.one_signal(timing.level_events(x, "fac", 0.97, 1.03, "other", 300.0, 600.0), "fac", 0, "1995-01-01").select("date", "code", "signal")


@query
def level_long(spark, sf):
    x = views.index_daily(spark, sf).withColumn("fac", steady(F.col("close") / F.col("open"), 6))
    return timing.one_signal(timing.level_events(x, "fac", 0.97, 1.03), "fac", 1).select("date", "code", "signal")


@query
def next_shipment(spark, sf):
    """Each order with its first shipment after the order's day, and what is shipped of it on that day."""
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), F.to_date("o_orderdate").alias("date"), "o_orderstatus")
    shipped = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("quantity"))
    return timing.next_after(orders, shipped, ["code"])


@query
def next_exit(spark, sf):
    """Each day on which a flag's bars open a long, with the first later day of the orders' table on which more than twice the usual number is placed."""
    bars = views.index_daily(spark, sf).withColumn("fac", steady(F.col("close") / F.col("open"), 6))
    entries = timing.level_events(bars, "fac", 0.97, 1.03).filter("lo").select("code", "date", "close")
    placed = views.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("R").alias("code")).agg(F.count("*").alias("placed"))
    usual = placed.groupBy("code").agg(F.avg("placed").alias("usual"))
    return timing.next_after(entries, placed.join(usual, "code").filter("placed > 2 * usual").select("code", "date", "placed"), ["code"], strict=False)


# More of evaluation and performance


@query
def group_nets(spark, sf):
    return evaluation.group_net_values(evaluation.equal_groups(_pairs(spark, sf), 5), "M")


def _index_returns(panel):
    """A benchmark a month: the mean price of all codes against the month before."""
    x = panel.groupBy("date").agg(steady(F.avg("open"), 4).alias("p"))
    return x.select("date", (ratio(F.col("p"), F.lag("p").over(Window.orderBy("date"))) - 1).alias("ret"))


@query
def long_against_index(spark, sf):
    return evaluation.against_index(evaluation.evaluate(_factor(spark, sf), views.panel(spark, sf), 5), _index_returns(views.panel(spark, sf))).select("date", "long_minus_index", "net_index")


@query
def factor_summary(spark, sf):
    x = kept(views.panel(spark, sf))  # its branches, and other queries, read one table
    return evaluation.factor_summary(x.select("date", "code", F.col("amount").alias("fac")), x, 5, "M", index=_index_returns(x))


@query
def factor_summaries(spark, sf):
    x = kept(views.panel(spark, sf))
    return evaluation.summaries({c: x.select("date", "code", F.col(c).alias("fac")) for c in ("amount", "vol")}, x, groups=5, freq="M", index=_index_returns(x))


@query
def long_side_by_year(spark, sf):
    return evaluation.long_side_by_year(evaluation.equal_groups(_pairs(spark, sf), 5), 5, 12)


@query
def relative_to_index(spark, sf):
    monthly = returns.by_period(views.returns(spark, sf), "month").select("strategy", F.last_day("period").alias("date"), (F.col("ret") / 100).alias("ret"))
    return returns.against_index(monthly, views.index_daily(spark, sf), "N", "M", 12)


@query
def excess_detail(spark, sf):
    return returns.detail(views.returns(spark, sf)).select("strategy", "excess_annual", "excess_sigma", "excess_sharpe", "excess_drawdown", "years", "bars")


@query
def sub_period(spark, sf):
    return returns.between_dates(views.returns(spark, sf), "1994-01-01", "1995-12-31").select("strategy", "annual", "sigma", "sharpe", "max_drawdown")


@query
def rolling_sharpes(spark, sf):
    return returns.rolling_sharpes(views.returns(spark, sf))


@query
def period_sums(spark, sf):
    x = views.returns(spark, sf)
    return returns.by_period(x, "month", "sum").withColumnRenamed("ret", "total").join(returns.by_period(x, "month", "total_lr").withColumnRenamed("ret", "log_total"), ["strategy", "period"]).join(returns.by_period(x.withColumn("ret", 1 + F.col("ret")), "month", "mul").withColumnRenamed("ret", "product"), ["strategy", "period"])


@query
def start_zero(spark, sf):
    return returns.start_at_zero(views.returns(spark, sf), "W")


# More of the option rules


def _priced(spark, sf):
    """Greeks, and what the rules need beside them: a margin, a price and a day's moves, all of the key."""
    x = options.greeks(views.option_book(spark, sf))
    key = F.col("opt_id")
    return x.withColumns({"margin": (key % 9 + 1) * 1000.0, "ds": (key % 11 - 5) / 2.0, "dv": (key % 5 - 2) / 100.0, "price": options.intrinsic_value(F.col("cp"), F.col("s"), F.col("k")) + key % 13 / 4.0})


@query
def option_values(spark, sf):
    c = F.col
    return _priced(spark, sf).select(
        "opt_id", options.value_change(c("delta"), c("gamma"), c("vega"), c("theta"), c("ds"), c("dv"), F.lit(1 / 252)).alias("change"), options.delta_after(c("delta"), c("gamma"), c("ds")).alias("delta_after"),
        options.intrinsic_value(c("cp"), c("s"), c("k")).alias("intrinsic"), options.time_value(c("price"), c("cp"), c("s"), c("k")).alias("time_value"),
    )


@query
def option_rules(spark, sf):
    c = F.col
    return _priced(spark, sf).select("opt_id", options.max_contracts(F.lit(50_000.0), c("margin")).alias("contracts"), options.theta_return(c("theta") / 252, c("margin")).alias("theta_return"), options.theta_covers_gamma(c("theta"), c("gamma"), c("sigma"), c("s")).alias("covered"), options.vega_days(c("vega"), c("theta") / 252).alias("vega_days")).select("opt_id", "contracts", "theta_return", "covered", *_digits("vega_days"))


@query
def sell_screen(spark, sf):
    return options.sell_screen(options.greeks(views.option_book(spark, sf))).select("opt_id")


@query
def close_at_expiry(spark, sf):
    # An option of an order expires when its quarter of a year ends; the book is looked at on the order's day and on that one.
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("opt_id"), F.to_date("o_orderdate").alias("day"))
    x = views.option_book(spark, sf).join(orders, "opt_id").withColumn("expiry", F.last_day(F.add_months("day", (2 - (F.month("day") - 1) % 3).cast("int"))))
    looked = x.withColumn("date", F.explode(F.array("day", "expiry")))
    return options.close_at_expiry(looked).groupBy("book", "expiry").agg(F.count("*").alias("looks"), F.count_if("close").alias("closes"))


@query
def hedge_trades(spark, sf):
    # A book's positions of one call, by key, stand for the steps of a path.
    x = options.greeks(views.option_book(spark, sf)).select((F.col("opt_id") % 500).alias("opt_id"), F.date_add(F.to_date(F.lit("1992-01-01")), F.floor(F.col("opt_id") / 500).cast("int")).alias("date"), "s", "gamma")
    return options.hedge_trades(x)


@query
def book_in_currency(spark, sf):
    books = options.share_equivalents(options.greeks(views.option_book(spark, sf))).withColumn("currency", F.substring("book", 1, 1))
    rates = spark.createDataFrame([(str(i), 1.0 + i / 4) for i in range(1, 6)], "currency string, rate double")
    return options.in_base_currency(books, rates).select("book", steady(F.col("sep"), 3).alias("sep"))


@query
def all_factors(spark, sf):
    return registry.compute(kept(views.bars(spark, sf)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From prices to the net values of a long-short portfolio of five groups."""
    return QUERIES["long_short"](spark, sf_dir)
