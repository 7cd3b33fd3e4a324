"""Raw segment rows to the seven columns of each segment.

Every function takes a history of any number of days; `file_date` is the day of a row's file and
part of every key.  Columns that are absent are left out at planning time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions.dates import compact, lenient_date

#: Columns of ours that pass through every step.
KEYS = ("file_date", "line_no")


def name(c: str) -> Column:
    return F.col(f"`{c}`")


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in this order, those that exist; keys stay."""
    return df.select(*[name(c) for c in columns if c in df.columns], *[k for k in KEYS if k in df.columns and k not in columns])


def move_before(df: DataFrame, columns: list[str], anchor: str) -> DataFrame:
    """`columns` to just before `anchor`; without the anchor the order stays."""
    if anchor not in df.columns:
        return df
    moved = [c for c in columns if c in df.columns]
    rest = [c for c in df.columns if c not in moved]
    at = rest.index(anchor)
    return df.select(*[name(c) for c in rest[:at] + moved + rest[at:]])


def without_symbols(df: DataFrame, denied: list[str] | DataFrame | None, column: str = "TckrSymb", small: int = 10_000) -> DataFrame:
    """Rows of denied symbols go, rows without a symbol stay.  `denied` is a list, or a table
    with a column `symbol`, which is broadcast if it has at most `small` rows."""
    if denied is None:
        return df
    if isinstance(denied, list):
        return df.where(~F.coalesce(F.col(column).isin(denied), F.lit(False))) if denied else df
    table = denied.select(F.col("symbol").alias("_denied")).distinct()
    if table.limit(small + 1).count() <= small:
        table = F.broadcast(table)
    return df.join(table, F.col(column) == F.col("_denied"), "left_anti")


def _equity(df: DataFrame, dropped: list[str], kept: list[str]) -> DataFrame:
    if "SctySrs" in df.columns:
        df = df.where(F.col("SctySrs").isin(kept))
    df = df.drop(*dropped, "SctySrs")
    if "TradDt" in df.columns:
        df = df.withColumn("TradDt", compact(lenient_date(F.col("TradDt"))))
    return move_before(df, ["TradDt"], "OpnPric")


def nse_eq(df: DataFrame) -> DataFrame:
    return _equity(df, specs.EQ_DROPPED, specs.NSE_SERIES)


def bse_eq(df: DataFrame, denied: list[str] | DataFrame | None = None) -> DataFrame:
    return _equity(without_symbols(df, denied), specs.EQ_DROPPED, specs.BSE_GROUPS)


def sme(df: DataFrame, suffix: bool = False) -> DataFrame:
    """The file's date before the open price; the symbol with _SME if asked for (null stays null)."""
    df = df.drop(*specs.SME_DROPPED).withColumn("DATE", compact(F.col("file_date")))
    if suffix and "SYMBOL" in df.columns:
        df = df.withColumn("SYMBOL", F.concat(F.col("SYMBOL").cast("string"), F.lit("_SME")))
    return move_before(df, ["DATE"], "OPEN_PRICE")


def nse_index(df: DataFrame) -> DataFrame:
    """The date is always the file's, whatever the column says."""
    df = df.drop(*specs.NSE_INDEX_DROPPED)
    after = [c for c in df.columns if c not in ("Index Name", "Index Date", *KEYS)]
    df = df.withColumn("Index Date", compact(F.col("file_date")))
    return select_present(df, ["Index Name", "Index Date", *after])


def bse_index(df: DataFrame) -> DataFrame:
    """Known columns, the file's date, volume 0.  Without any known column: no rows."""
    present = [c for c in specs.BSE_INDEX_KEPT if c in df.columns]
    keyed = df.select(*present, *[k for k in KEYS if k in df.columns])
    if not present:
        keyed = keyed.where(F.lit(False))
    keyed = keyed.withColumn("Date", compact(F.col("file_date"))).withColumn("Volume", F.lit(0).cast("bigint"))
    return select_present(keyed, specs.BSE_INDEX_ORDER)


def by_symbol(df: DataFrame, column: str = "TckrSymb") -> DataFrame:
    """O1: each day's rows in the order of symbols, nulls last, then of lines; no sort across days."""
    return df.repartition("file_date").sortWithinPartitions("file_date", F.asc_nulls_last(column), "line_no")


def date_quality(df: DataFrame, column: str = "TradDt", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """per day, rows whose date text isn't a date, that have none, and whose date isn't the file's."""
    day, text = lenient_date(name(column), fmt), name(column)
    return df.groupBy("file_date").agg(
        F.count("*").alias("n_rows"),
        F.count_if(day.isNull() & text.isNotNull()).alias("n_bad"),
        F.count_if(text.isNull()).alias("n_missing"),
        F.count_if(day != F.col("file_date")).alias("n_other_day"),
    )


NORMALIZERS = {"NSE_EQ": nse_eq, "BSE_EQ": bse_eq, "NSE_SME": sme, "NSE_INDEX": nse_index, "BSE_INDEX": bse_index}
