"""Futures rows and their continuous names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions.dates import compact, lenient_date
from eodlake.functions.text import contract_symbol
from eodlake.operators.normalize import move_before

TIES = ("FinInstrmId",)


def _bad() -> Column:
    """A ticker that is missing, or an expiry text that isn't a date; a missing expiry is fine."""
    return F.col("TckrSymb").isNull() | (F.col("XpryDt").isNotNull() & lenient_date(F.col("XpryDt")).isNull())


def quarantine(df: DataFrame) -> DataFrame:
    """Futures that cannot be named, with the reason; the rest of their day goes on."""
    reason = F.when(F.col("TckrSymb").isNull(), F.lit("no ticker")).otherwise(F.lit("bad expiry"))
    return df.where(F.col("FinInstrmTp").isin(specs.FUTURES)).where(_bad()).withColumn("reason", reason)


def number_contracts(df: DataFrame, ties: tuple[str, ...] = TIES) -> DataFrame:
    """Contracts of a day and ticker by expiry, 1 on; missing expiries last, equal ones by `ties`.

    Options go first and columns are few, so the one shuffle, by day and ticker, is small."""
    named = df.where(F.col("FinInstrmTp").isin(specs.FUTURES)).where(~_bad()).withColumn("_expiry", lenient_date(F.col("XpryDt")))
    order = Window.partitionBy("file_date", "TckrSymb").orderBy(F.asc_nulls_last("_expiry"), *ties)
    return named.withColumn("contract_no", F.row_number().over(order)).drop("_expiry")


def nse_fo(df: DataFrame, ties: tuple[str, ...] = TIES) -> DataFrame:
    out = number_contracts(df, ties).withColumn("SYMBOL_NEW", contract_symbol(F.col("TckrSymb"), F.col("contract_no")))
    out = out.drop(*[c for c in specs.FO_DROPPED if c != "TradDt"], *[t for t in ties if t not in ("OpnPric",)], "TckrSymb", "XpryDt", "contract_no")
    if "TradDt" in out.columns:
        out = out.withColumn("TradDt", compact(lenient_date(F.col("TradDt"))))
    return move_before(out, ["SYMBOL_NEW", "TradDt"], "OpnPric")
