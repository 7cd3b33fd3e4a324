"""The trading calendar as a table, and lookups in it by equality.

A calendar has one row per day of a stretch that is padded on both sides; fact tables meet it by
an equality join on the date, never by a range.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake.functions.dates import data_available, holiday_date, is_weekend

PAD = 31


def days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(d) from start to end; none if they are reversed."""
    n = (end - start).days + 1
    return spark.range(max(n, 0)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))


def calendar(spark: SparkSession, start: date, end: date, holidays: DataFrame, skip_weekends: bool = True, skip_holidays: bool = True, pad: int = PAD) -> DataFrame:
    """-> d, is_weekend, is_holiday, is_trading, trading_idx (trading days up to d), last_trading_day (on or
    before), next_trading_day (after).  `holidays`: (holiday DATE), null and repeated ones ignored.

    A few thousand rows, so windows over all of it are one small task (W2)."""
    free = holidays.select(F.col("holiday").alias("d")).where("d is not null").distinct().withColumn("_h", F.lit(True))
    cal = days(spark, start - timedelta(days=pad), end + timedelta(days=pad)).join(F.broadcast(free), "d", "left")
    weekend, holiday = is_weekend(F.col("d")), F.coalesce("_h", F.lit(False))
    trading = ~(F.lit(skip_weekends) & weekend) & ~(F.lit(skip_holidays) & holiday)
    cal = cal.select("d", weekend.alias("is_weekend"), holiday.alias("is_holiday"), trading.alias("is_trading"))
    order = Window.orderBy("d")
    day = F.when(F.col("is_trading"), F.col("d"))
    return (
        cal.withColumn("trading_idx", F.sum(F.col("is_trading").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last_trading_day", F.last(day, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_trading_day", F.first(day, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    )


def calendar_for(facts: DataFrame, columns: list[str], holidays: DataFrame, pad: int = PAD, **flags: bool) -> DataFrame:
    """The calendar that these date columns need: from their least to their greatest day, padded.  One scan of the columns; without a date, an empty one."""
    ends = facts.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    known = [d for d in ends if d is not None]
    first, last = (min(known), max(known)) if known else (date(1970, 1, 1) + timedelta(days=2 * pad), date(1970, 1, 1) - timedelta(days=1))
    return calendar(facts.sparkSession, first, last, holidays, pad=pad, **flags)


def parse_holidays(lines: DataFrame, column: str = "value", iso: bool = False) -> DataFrame:
    """(holiday), each once; lines without a date are left out."""
    return lines.select(holiday_date(F.col(column), iso).alias("holiday")).where("holiday is not null").distinct()


def bad_holiday_lines(lines: DataFrame, column: str = "value", iso: bool = False) -> DataFrame:
    return lines.where(holiday_date(F.col(column), iso).isNull() & (F.trim(column) != ""))


def explode_range(df: DataFrame, start: Column, end: Column, name: str = "d") -> DataFrame:
    """One row per day; a reversed range has none (a sequence would count down)."""
    return df.where(start <= end).withColumn(name, F.explode(F.sequence(start, end)))


def trading_days(ranges: DataFrame, cal: DataFrame, start: str, end: str) -> DataFrame:
    """One row per trading day of each range; a day outside the calendar is an error."""
    met = explode_range(ranges, F.col(start), F.col(end)).join(_lookup(cal, "is_trading", prefix="_c_"), F.col("d") == F.col("_c_d"), "left")
    return met.where(_known(F.col("_c_is_trading"), F.col("d"))).drop("_c_d", "_c_is_trading")


def days_of_months(df: DataFrame, cal: DataFrame, month: str, out: str = "d") -> DataFrame:
    """One row per trading day of each row's month (`month` is any day of it), by equality on the month; a month that the calendar
    doesn't hold whole is an error."""
    whole = cal.groupBy(F.trunc("d", "month").alias("_m")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("is_trading"), F.col("d")))).alias("_days"))
    met = df.join(F.broadcast(whole), F.trunc(F.col(month), "month") == F.col("_m"), "left")
    days = _known(F.when(F.col("_n") == F.dayofmonth(F.last_day(F.col(month))), F.col("_days")), F.col(month))
    return met.withColumn(out, F.explode(days)).drop("_m", "_n", "_days")


def month_trading_days(cal: DataFrame, year: int, month: int) -> DataFrame:
    """The trading days of one month."""
    first = cal.sparkSession.createDataFrame([(date(year, month, 1),)], "month date")
    return days_of_months(first, cal, "month").select("d")


def _lookup(cal: DataFrame, *columns: str, prefix: str) -> DataFrame:
    return F.broadcast(cal.select(F.col("d").alias(f"{prefix}d"), *[F.col(c).alias(f"{prefix}{c}") for c in columns]))


def _known(found: Column, asked: Column) -> Column:
    """A date outside the calendar is an error, not a null."""
    return F.when(asked.isNotNull() & found.isNull(), F.raise_error(F.lit("date outside the calendar"))).otherwise(found)


def with_last_trading_day(df: DataFrame, cal: DataFrame, day: str, out: str = "last_trading_day") -> DataFrame:
    """On or before."""
    c = _lookup(cal, "last_trading_day", prefix="_c_")
    return df.join(c, F.col(day) == F.col("_c_d"), "left").withColumn(out, _known(F.col("_c_last_trading_day"), F.col(day))).drop("_c_d", "_c_last_trading_day")


def with_next_trading_day(df: DataFrame, cal: DataFrame, day: str, out: str = "next_trading_day") -> DataFrame:
    """Strictly after."""
    c = _lookup(cal, "next_trading_day", prefix="_c_")
    return df.join(c, F.col(day) == F.col("_c_d"), "left").withColumn(out, _known(F.col("_c_next_trading_day"), F.col(day))).drop("_c_d", "_c_next_trading_day")


def add_trading_days(df: DataFrame, cal: DataFrame, day: str, n: str, out: str = "shifted") -> DataFrame:
    """The n-th trading day after; n <= 0 gives the day itself, trading or not."""
    c = _lookup(cal, "trading_idx", prefix="_c_")
    t = F.broadcast(cal.where("is_trading").select(F.col("d").alias("_t_d"), F.col("trading_idx").alias("_t_idx")))
    met = df.join(c, F.col(day) == F.col("_c_d"), "left").join(t, (F.col("_c_trading_idx") + F.col(n) == F.col("_t_idx")) & (F.col(n) > 0), "left")
    found = F.when(F.col(n) <= 0, F.col(day)).otherwise(F.col("_t_d"))
    return met.withColumn(out, F.when(F.col(n).isNotNull(), _known(found, F.col(day)))).drop("_c_d", "_c_trading_idx", "_t_d", "_t_idx")


def count_trading_days(df: DataFrame, cal: DataFrame, start: str, end: str, out: str = "n_trading_days") -> DataFrame:
    """In [start, end], 0 if reversed; two lookups of the running count; a date outside the calendar is an error."""
    a, b = _lookup(cal, "trading_idx", "is_trading", prefix="_a_"), _lookup(cal, "trading_idx", prefix="_b_")
    met = df.join(a, F.col(start) == F.col("_a_d"), "left").join(b, F.col(end) == F.col("_b_d"), "left")
    first, last = _known(F.col("_a_trading_idx"), F.col(start)), _known(F.col("_b_trading_idx"), F.col(end))
    n = last - first + F.col("_a_is_trading").cast("bigint")
    n = F.when(F.col(start) > F.col(end), F.lit(0).cast("bigint")).otherwise(n)
    return met.withColumn(out, n).drop(*[c for c in met.columns if c.startswith(("_a_", "_b_"))])


def with_expected_date(df: DataFrame, cal: DataFrame, ts: str, out: str = "expected_date") -> DataFrame:
    """The last trading day whose data is out at a moment (local time)."""
    today = F.to_date(F.col(ts))
    c = _lookup(cal, "is_trading", "last_trading_day", prefix="_c_")
    p = _lookup(cal, "last_trading_day", prefix="_p_")
    met = df.join(c, today == F.col("_c_d"), "left").join(p, F.date_sub(today, 1) == F.col("_p_d"), "left")
    wait = F.col("_c_is_trading") & ~data_available(F.col(ts))
    found = F.when(wait, F.col("_p_last_trading_day")).otherwise(F.col("_c_last_trading_day"))
    return met.withColumn(out, _known(found, F.col(ts))).drop(*[c for c in met.columns if c.startswith(("_c_", "_p_"))])
