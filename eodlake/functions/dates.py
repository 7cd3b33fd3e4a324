"""Dates out of texts and file names, and times of the trading day, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is looked for in a file name; the first match counts.
NAME_PATTERNS = {"yyyy-MM-dd": r"(\d{4}-\d{2}-\d{2})", "yyyyMMdd": r"(\d{8})", "ddMMyy": r"(\d{6})", "ddMMyyyy": r"(\d{8})"}
HOLIDAY_FORMATS = ("d/M/yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy")
ISO_FORMATS = ("yyyy-M-d", "d-M-yyyy")


def lenient_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A date, or null where the text isn't one.  Two-digit years from 69 on are of the 1900s."""
    day = F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    if fmt.endswith("yy") and not fmt.endswith("yyyy"):
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day


def compact(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def format_for(day: Column, fmt: Column) -> Column:
    """A date in the format that another column names."""
    return F.when(fmt == "yyyyMMdd", F.date_format(day, "yyyyMMdd")).when(fmt == "ddMMyy", F.date_format(day, "ddMMyy")).when(fmt == "ddMMyyyy", F.date_format(day, "ddMMyyyy"))


def date_in_name(name: Column, fmt: str) -> Column:
    """Null for a name without a match, a match that isn't a date, and a format that isn't known."""
    if fmt not in NAME_PATTERNS:
        return F.lit(None).cast("date")
    return lenient_date(F.nullif(F.regexp_extract(name, NAME_PATTERNS[fmt], 1), F.lit("")), fmt)


def raw_name_date(name: Column, pattern: str, fmt: str) -> Column:
    """The date in a raw file's name."""
    return lenient_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), fmt)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def in_market_hours(ts: Column) -> Column:
    """09:15 to 15:30, both included, at full precision."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    return (second >= 33300) & (second <= 55800)


def data_available(ts: Column) -> Column:
    """From 18:00."""
    return F.hour(ts) >= 18


def holiday_date(line: Column, iso: bool = False) -> Column:
    """The date of a line "date - text" or "date, text".  A hyphen always starts the text, so dates
    written with hyphens are only read with `iso`."""
    part = F.trim(F.split(F.trim(F.split(line, "-")[0]), ",")[0])
    tries = [lenient_date(part, f) for f in HOLIDAY_FORMATS]
    if iso:
        whole = F.trim(F.split(F.trim(line), "[ ,]")[0])
        tries = [lenient_date(whole, f) for f in ISO_FORMATS] + tries
    return F.coalesce(*tries)
