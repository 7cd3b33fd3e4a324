"""What is stored and what is missing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eodlake.functions.dates import lenient_date
from eodlake.functions.text import says_absent

FILE_PATTERN = r"^(\d{4}-\d{2}-\d{2})-([A-Z]+)-([A-Z]+)\.(txt|csv)"


def stored_files(files: DataFrame) -> DataFrame:
    """(file_name, length) -> exchange, segment, file_date (null if not a date), length.  The pattern is
    anchored at the start only; other names are left out."""
    part = lambda i: F.regexp_extract("file_name", FILE_PATTERN, i)
    return files.where(F.col("file_name").rlike(FILE_PATTERN)).select("file_name", part(2).alias("exchange"), part(3).alias("segment"), lenient_date(part(1)).alias("file_date"), "length")


def segment_summary(segments: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (bad dates count), last date (they don't), first run, integrity; every segment has a row."""
    stats = stored.groupBy("exchange", "segment").agg(
        F.count("*").alias("n"), F.max("file_date").alias("last_date"), F.count_if(F.col("length") > 0).alias("full")
    )
    return segments.select("exchange", "segment").join(stats, ["exchange", "segment"], "left").select(
        "exchange", "segment", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_files"), "last_date",
        F.col("last_date").isNull().alias("is_first_run"), (F.coalesce("full", F.lit(0)) > 0).alias("is_valid"),
    )


def missing_days(summary: DataFrame, cal: DataFrame, expected: date) -> DataFrame:
    """Trading days after a segment's last stored day, up to the expected one."""
    trading = cal.where(F.col("is_trading") & (F.col("d") <= F.lit(expected))).select(F.col("d").alias("missing_date"))
    return summary.where("last_date is not null").join(F.broadcast(trading), F.col("missing_date") > F.col("last_date")).select("exchange", "segment", "missing_date")


def gaps(summary: DataFrame, stored: DataFrame, cal: DataFrame, first: date, expected: date) -> DataFrame:
    """Trading days from `first` on without a file, gaps before the last stored day included."""
    trading = cal.where(F.col("is_trading") & F.col("d").between(F.lit(first), F.lit(expected))).select(F.col("d").alias("file_date"))
    wanted = summary.select("exchange", "segment").join(F.broadcast(trading))
    return wanted.join(stored.select("exchange", "segment", "file_date").distinct(), ["exchange", "segment", "file_date"], "left_anti").withColumnRenamed("file_date", "missing_date")


def coverage(summary: DataFrame, cal: DataFrame, expected: date) -> DataFrame:
    """A5: days missing and whether a segment is up to date (not, if nothing is stored)."""
    n = missing_days(summary, cal, expected).groupBy("exchange", "segment").agg(F.count("*").alias("n"))
    return summary.join(n, ["exchange", "segment"], "left").select(
        "exchange", "segment", "last_date", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_missing"), F.coalesce(F.col("last_date") >= F.lit(expected), F.lit(False)).alias("up_to_date")
    )


def overall_status(covered: DataFrame) -> DataFrame:
    """One row over the chosen segments."""
    name = F.concat_ws("_", "exchange", "segment")
    reason = F.when(F.col("last_date").isNull(), F.concat(name, F.lit(" (No data found)"))).when(
        ~F.col("up_to_date"), F.concat(name, F.lit(" (Missing "), F.col("n_missing").cast("string"), F.lit(" days)"))
    )
    return covered.agg(
        F.bool_and("up_to_date").alias("all_up_to_date"),
        F.concat_ws(", ", F.sort_array(F.collect_list(reason))).alias("reasons"),
        F.max("last_date").alias("last_date"),
        F.countDistinct("last_date").alias("n_last_dates"),
    )


def missing_severity(log: DataFrame, cal: DataFrame, segments: DataFrame, as_of: date) -> DataFrame:
    """Failed fetches with the day's kind and how serious each is."""
    s = F.broadcast(segments.select(F.col("name").alias("segment_name"), "timeout_means_absent", "critical"))
    c = F.broadcast(cal.select("d", "is_weekend", "is_holiday"))
    met = log.where("not success").join(s, F.col("segment") == F.col("segment_name")).join(c, F.col("target_date") == F.col("d"), "left")
    kind = (
        F.when(F.col("target_date") == F.lit(as_of), "today")
        .when(F.coalesce("is_weekend", F.lit(False)), "weekend")
        .when(F.coalesce("is_holiday", F.lit(False)), "holiday")
        .otherwise("trading")
    )
    severity = F.when(~says_absent(F.col("error_message"), F.col("timeout_means_absent")), "failed").when(kind != "trading", "info").when(F.col("critical"), "critical").otherwise("notice")
    return met.withColumn("day_kind", kind).withColumn("severity", severity).drop("segment_name", "timeout_means_absent", "critical", "d", "is_weekend", "is_holiday")
