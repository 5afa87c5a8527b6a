"""The domain's shapes on the order tables: a monthly panel, daily index bars, intraday bars, attributes.

Prices and volumes are rounded at this point, so that what is built on them doesn't depend on the
order in which a sum was taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import ratio, steady
from gridloom.operators.series import lagged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, keys: list[Column]) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    # (order, line) isn't unique, with part and supplier it is.
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.groupBy(*keys).agg(
        steady(F.min_by(unit, at), 4).alias("open"), steady(F.max(unit), 4).alias("high"), steady(F.min(unit), 4).alias("low"), steady(F.max_by(unit, at), 4).alias("last"),
        steady(F.avg(unit), 4).alias("mean"), steady(F.sum("l_quantity"), 2).alias("vol"), steady(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (month), code (supplier), open, high, low, close (mean), vol, amount."""
    out = _bars(table(spark, sf_dir, "lineitem"), [F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").cast("string").alias("code")])
    return out.select("date", "code", "open", "high", "low", F.col("mean").alias("close"), "vol", "amount")


def index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, code (return flag), open, high, low, close, vol, pre_close, pct_change."""
    out = _bars(table(spark, sf_dir, "lineitem"), [F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("code")]).withColumnRenamed("last", "close")
    out = out.select("date", "code", "open", "high", "low", "close", "vol").withColumn("pre_close", lagged("close"))
    return out.withColumn("pct_change", ratio(F.col("close"), F.col("pre_close")) - 1)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code (event type), date, seq, close, high, low, volume, amount of the intraday table."""
    value = F.col("value")
    volume = F.get_json_object("props", "$.k").cast("int") + 1
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("code"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), value.alias("close"), (value * 1.01).alias("high"), (value * 0.99).alias("low"),
        volume.alias("volume"), steady(value * volume, 2).alias("amount"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, industry (nation), circ_mv."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").alias("industry"), F.col("s_acctbal").alias("circ_mv"))


def option_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each order: opt_id, book, cp, s, k, t_years, r, sigma, q, contracts, multiplier."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("opt_id"), F.col("o_orderpriority").alias("book"), F.when(key % 2 == 0, "C").otherwise("P").alias("cp"), (50 + key % 101).cast("double").alias("s"), (60 + key % 83).cast("double").alias("k"),
        ((key % 24 + 1) / 12.0).alias("t_years"), F.lit(0.03).alias("r"), (0.1 + (key % 40) / 100.0).alias("sigma"), (key % 3 / 100.0).alias("q"), (key % 21 - 10).cast("int").alias("contracts"), F.lit(100).alias("multiplier"),
    )


def tame(change: Column) -> Column:
    """A hundredth of a change between -0.5 and 0.5, so that long products stay in range."""
    return F.when(change.isNotNull(), steady(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), change)) / 100, 8))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, date, ret and the benchmark's ret (the mean of all), from the index bars; returns within half."""
    daily = index_daily(spark, sf_dir).filter("pct_change is not null").select(F.col("code").alias("strategy"), "date", tame(F.col("pct_change")).alias("ret"))
    mean = daily.groupBy("date").agg(steady(F.avg("ret"), 10).alias("bench"))
    return daily.join(mean, "date")
