"""What to fetch next."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions.dates import format_for
from eodlake.functions.text import file_url, output_name


def end_date(cal: DataFrame, as_of: datetime) -> DataFrame:
    """(end_date): the day of `as_of`, or the trading day before where it trades and it is before 18:00."""
    today = as_of.date()
    row = cal.where(F.col("d") == F.lit(today)).select("is_trading").alias("t")
    before = cal.where(F.col("d") == F.lit(today - timedelta(days=1))).select(F.col("last_trading_day"))
    return before.join(row).select(F.when(F.col("is_trading") & F.lit(as_of.hour < 18), F.col("last_trading_day")).otherwise(F.lit(today)).alias("end_date"))


def date_ranges(segments: DataFrame, last_dates: DataFrame, cal: DataFrame, as_of: datetime, custom_start: date | None = None, custom_end: date | None = None, base_start: date = specs.BASE_START) -> DataFrame:
    """-> segments' columns, start_date, end_date.  Starts the day after the last stored one,
    or at `base_start`, not before a segment's data exists; a start after the end is an empty range."""
    if custom_start and custom_end and custom_start > custom_end:
        raise ValueError("start date after end date")
    last = last_dates.select("exchange", "segment", "last_date")
    end = end_date(cal, as_of) if custom_end is None else cal.sparkSession.createDataFrame([(custom_end,)], "end_date date")
    start = F.coalesce(F.lit(custom_start).cast("date"), F.date_add("last_date", 1), F.lit(base_start))
    out = segments.join(last, ["exchange", "segment"], "left").join(F.broadcast(end))
    return out.withColumn("start_date", F.greatest(start, F.col("available_from")))


def fetch_manifest(ranges: DataFrame, cal: DataFrame, include_weekends: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """One row per segment and working day with its url and output name.  With `stored`
    (exchange, segment, file_date) days that are there already are left out."""
    kept = cal.where(~F.col("is_holiday") & (F.lit(include_weekends) | ~F.col("is_weekend"))).select("d")
    out = ranges.join(F.broadcast(kept), F.col("d").between(F.col("start_date"), F.col("end_date")))
    if stored is not None:
        have = stored.select("exchange", "segment", F.col("file_date").alias("d")).distinct()
        out = out.join(have, ["exchange", "segment", "d"], "left_anti")
    text = format_for(F.col("d"), F.col("date_format"))
    return out.select(
        "exchange", "segment", F.col("d").alias("target_date"),
        file_url(F.col("base_url"), F.col("filename_pattern"), text).alias("url"), output_name(F.col("d"), F.col("file_suffix")).alias("file_name"),
    )


def pending(ranges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Days to fetch per segment and the next range; segments without any stay with 0."""
    n = manifest.groupBy("exchange", "segment").agg(F.count("*").alias("n"), F.min("target_date").alias("next_from"), F.max("target_date").alias("next_to"))
    return ranges.select("exchange", "segment").join(n, ["exchange", "segment"], "left").withColumn("n_pending", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")
