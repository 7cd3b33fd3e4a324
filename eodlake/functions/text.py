"""Names, numerals and message classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]

#: T5: (words looked for, class, retry) in the order in which they are tried.
ERROR_LADDER = (
    (("timeout",), "timeout", True),
    (("connection", "network", "reset", "refused"), "network", True),
    (("500", "502", "503", "504"), "server_error", True),
    (("404", "not found"), "file_not_found", False),
    (("403", "401", "forbidden", "unauthorized"), "access_denied", False),
    (("ssl", "certificate", "cert"), "ssl_error", True),
)


def roman(n: Column) -> Column:
    """T3: '' for 0; M is repeated from 1000 on."""
    pick = lambda names, d: F.element_at(F.array(*map(F.lit, names)), (d % 10 + 1).cast("int"))
    n = n.cast("bigint")
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), pick(HUNDREDS, F.floor(n / 100)), pick(TENS, F.floor(n / 10)), pick(UNITS, n))


def contract_symbol(ticker: Column, number: Column) -> Column:
    """T4: TICKER-ROMAN."""
    return F.concat(ticker, F.lit("-"), roman(number))


def file_url(base: Column, pattern: Column, day_text: Column) -> Column:
    """T1."""
    return F.concat(base, F.lit("/"), F.replace(pattern, F.lit("{date}"), day_text))


def output_name(day: Column, suffix: Column, ext: str = "txt") -> Column:
    """T2."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), suffix, F.lit(f".{ext}"))


def money(value: Column) -> Column:
    """Two decimals, half up; null stays null."""
    return value.cast("decimal(18,2)").cast("string")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def error_class(message: Column) -> Column:
    low, out = F.lower(message), F.lit("unknown")
    for words, kind, _ in reversed(ERROR_LADDER):
        out = F.when(_has(low, words), F.lit(kind)).otherwise(out)
    return F.when(message.isNull() | (message == ""), F.lit("unknown")).otherwise(out)


def should_retry(kind: Column) -> Column:
    return kind.isin([k for _, k, retry in ERROR_LADDER if retry])


def says_absent(message: Column, timeout_counts: Column) -> Column:
    """The file isn't there (yet), rather than failed."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return low.contains("not available") | F.coalesce(message, F.lit("")).contains("404") | (timeout_counts & low.contains("timeout"))
