"""Readers of daily tables, calendars and bars, and the incremental load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The daily fields in the order in which a request with several flags is answered.
FIELDS = ("open", "close", "high", "low", "vol", "amount", "circ_mv", "total_mv", "pct_chg", "limit_up", "limit_down", "turnover")


def trading_days(calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Open days between two dates, ascending (cal_date DATE, is_open BOOLEAN)."""
    days = calendar.filter("is_open").select("cal_date")
    return between(days, "cal_date", start, end).orderBy("cal_date")


def between(df: DataFrame, col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of an inclusive date range; an open end is left out, so the scan still gets the filter."""
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            day = F.to_date(F.lit(bound))
            df = df.filter(F.col(col) >= day if low else F.col(col) <= day)
    return df


def week_end(date: Column) -> Column:
    """The Sunday that closes the date's week."""
    return F.date_add(F.date_trunc("week", date).cast("date"), 6)


def resample(df: DataFrame, field: str, freq: str, how: str = "last") -> DataFrame:
    """date, code and the period's first or last non-null value; D keeps days, W, M and Y are labelled by their end."""
    if freq == "D":
        return df.select("date", "code", field)
    label = {"W": week_end(F.col("date")), "M": F.last_day("date"), "Y": F.make_date(F.year("date"), F.lit(12), F.lit(31))}[freq]
    pick = F.min_by if how == "first" else F.max_by
    return df.filter(F.col(field).isNotNull()).groupBy(label.alias("date"), "code").agg(pick(field, "date").alias(field))


def read_daily(daily: DataFrame, field: str, *, adjusted: bool = True, start: str | None = None, end: str | None = None, freq: str = "W", calendar: DataFrame | None = None) -> DataFrame:
    """One field of the daily table as a long panel, on trading days, resampled (open takes a period's first value)."""
    if field not in FIELDS:
        raise ValueError(f"name one of {FIELDS}")
    if field.startswith("limit") and adjusted or field == "turnover" and not adjusted:
        raise ValueError(f"{field} is not in the {'adjusted' if adjusted else 'unadjusted'} table")
    rows = between(daily, "date", start, end).select("date", "code", field)
    if calendar is not None:
        rows = rows.join(calendar.filter("is_open").select(F.col("cal_date").alias("date")), "date", "left_semi")
    return resample(rows, field, freq, "first" if field == "open" else "last")


def read_market(daily: DataFrame, field: str, code: str, *, freq: str = "W", start: str | None = None, end: str | None = None) -> DataFrame:
    """The same of a single index, always the period's last value."""
    return resample(between(daily.filter(F.col("code") == code), "date", start, end).select("date", "code", field), field, freq)


def index_data(daily: DataFrame, code: str, start: str | None = None, end: str | None = None, fields: list[str] | None = None) -> DataFrame:
    rows = between(daily.filter(F.col("code") == code), "date", start, end)
    return (rows.select(*fields) if fields else rows).orderBy("date")


def industry_members(table: DataFrame) -> DataFrame:
    return table.select(F.col("ts_code").alias("code"), F.col("l1code").alias("industry"), "in_date", "out_date")


def style_factor(spark: SparkSession, path: str, style: str) -> DataFrame:
    """One style's rows of a table partitioned by ``style``: only its folder is read."""
    return spark.read.parquet(path).filter(F.col("style") == style)


def status_rows(table: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return between(table, "date", start, end).orderBy("code", "date")


def minute_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All bar files of a folder but hidden ones, as one table."""
    return between(spark.read.option("pathGlobFilter", "[!._]*").parquet(path), "date", start, end)


def index_bars(df: DataFrame) -> DataFrame:
    """Vendor names to ours, and the change against the previous close."""
    out = df.withColumnsRenamed({"order_book_id": "code", "volume": "vol", "prev_close": "pre_close"})
    return out.withColumn("pct_change", F.try_divide("close", "pre_close") - 1)


def jdbc_table(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 1, options: dict[str, str] | None = None) -> DataFrame:
    """A database table; with ``column`` and ``bounds`` it is read in ``parts`` ranges."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", table)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def append_jdbc(df: DataFrame, url: str, table: str, *, options: dict[str, str] | None = None) -> None:
    """Appends the rows to a database table."""
    df.write.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", table).mode("append").save()


def append_table(df: DataFrame, path: str, partition: str = "date") -> None:
    df.write.mode("append").partitionBy(partition).parquet(path)


def save_factor(df: DataFrame, path: str) -> None:
    """One folder for each factor_name; rewriting one leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_name").parquet(path)


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{c}` {t}' for c, t in columns.items())}) USING parquet")


def vendor_export(spark: SparkSession, paths: list[str], names: list[str], *, drop: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """CSV exports of one vendor table as one: columns in ``drop`` go, the others get ``names`` by position.

    Below its column names a file has rows of titles and units; they go, as their ``key`` (the first name, if not given)
    doesn't begin with a digit.  All columns stay text; ``_file`` names the file, in whose order ``read_exports`` takes the last.
    """
    raw = spark.read.option("header", True).csv(paths).withColumn("_file", F.input_file_name())
    kept = raw.drop(*drop)
    out = kept.toDF(*names, "_file")
    return out.filter(F.col(key or names[0]).rlike("^[0-9]"))


def read_exports(df: DataFrame, order: str) -> DataFrame:
    """One row for each (date, code) of several vendor exports: the last by ``order``."""
    last = F.max_by(F.struct(*[c for c in df.columns if c not in ("date", "code")]), order).alias("x")
    return df.groupBy("date", "code").agg(last).select("date", "code", "x.*")


def complete_until(daily: DataFrame, expected: DataFrame) -> DataFrame:
    """date: the last day whose distinct codes reach the ``expected`` count (date, n)."""
    held = daily.groupBy("date").agg(F.countDistinct("code").alias("have"))
    return held.join(expected, "date").filter("have >= n").agg(F.max("date").alias("date"))


def is_open_day(calendar: DataFrame, date: str) -> bool:
    """Whether the calendar has the day as an open one; a load on another day has nothing to do."""
    return not calendar.filter("is_open").filter(F.col("cal_date") == F.to_date(F.lit(date))).isEmpty()


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rewrite_partitions(df: DataFrame, path: str, partition: str = "date") -> None:
    """Writes the partitions that ``df`` holds anew; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def new_rows(daily: DataFrame, loaded: DataFrame, initial: bool = False) -> DataFrame:
    """What is later than the loaded high-water mark, or everything on the initial load."""
    if initial:
        return daily
    mark = loaded.agg(F.max("date").alias("mark"))
    return daily.join(mark, F.col("mark").isNull() | (F.col("date") > F.col("mark"))).drop("mark")


def without(daily: DataFrame, *, codes: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """The table less some codes or a day, to be written over it."""
    if date is not None:
        daily = daily.filter(F.col("date") != F.to_date(F.lit(date)))
    return daily if codes is None else daily.join(codes.select("code"), "code", "left_anti")


def all_stocks(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    return listed.unionByName(delisted, allowMissingColumns=True)


def active(stocks: DataFrame) -> DataFrame:
    return stocks.filter("list_status = 'L'")
