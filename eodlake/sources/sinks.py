"""The lake and its text exports (K1-K4)."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions.text import money, output_name
from eodlake.operators.append import ordered_by_month
from eodlake.operators.normalize import name
from eodlake.sources.named import write_named

PARTITIONS = ("exchange", "segment", "file_date")
LAKE_PARTITIONS = ("exchange", "segment", "file_month")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def write_lake(df: DataFrame, path: str) -> None:
    """K2, K4: the months in `df`, given whole, replace those in the lake, others stay; running it again
    changes nothing.  Months, not days, are the folders, so a long history isn't many small files.

    The one big shuffle is by month, and large months are split to several files."""
    keyed = df.withColumn("file_month", month_of(F.col("file_date")))
    keyed = keyed.hint("rebalance", *[F.col(c) for c in LAKE_PARTITIONS]).sortWithinPartitions(*LAKE_PARTITIONS, "file_date", "row_order")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAKE_PARTITIONS).parquet(path)


def write_ordered(df: DataFrame, path: str) -> None:
    """K2, K4, O3: consolidated rows, months given whole, get their order and replace their months in the lake, with one shuffle and one sort of
    the rows: those that are numbered stand in the order of folders and days already.

    A month is one task's; for months too large for that, `write_lake(ordered(df), path)` deals twice."""
    ordered_by_month(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAKE_PARTITIONS).parquet(path)


def csv_line(columns: list[str]) -> Column:
    """Columns as one line of CSV: quoted where they must be, blanks kept, null as nothing."""
    plain = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "", "escape": '"', "quote": '"'}
    return F.to_csv(F.struct(*[name(c) for c in columns]), plain)


def write_combined(df: DataFrame, path: str) -> None:
    """K3: a text with a header per day, `<EXCH>_<SEG>_DDMMYYYY_combined.csv` (an export: the lake itself is by month).  It has the
    data's columns; `row_order` only orders its lines."""
    columns = [c for c in df.columns if c not in (*PARTITIONS, "row_order")]
    file_name = F.concat_ws("_", "exchange", "segment", F.date_format("file_date", "ddMMyyyy"), F.lit("combined.csv"))
    write_named(df.select(file_name.alias("file_name"), csv_line(columns).alias("line"), "row_order"), path, ["row_order"], header=",".join(columns))


def export_lines(df: DataFrame, appended_money: bool = True) -> DataFrame:
    """Headerless lines as text columns: appended rows' prices with two decimals, whole volumes without any."""
    eq = F.col("source_segment") == "EQ"
    price = lambda c: F.when(eq | ~F.lit(appended_money), F.col(c).cast("string")).otherwise(money(F.col(c))).alias(c)
    volume = F.when(F.col("volume") == F.floor("volume"), F.col("volume").cast("bigint").cast("string")).otherwise(F.col("volume").cast("string"))
    return df.select(*PARTITIONS, "row_order", "symbol", "trade_date", *[price(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))


def export_days(df: DataFrame, suffix: str) -> DataFrame:
    """K1: -> file_name, content: one headerless text per day, named YYYY-MM-DD<suffix>.txt.

    Rows are shuffled to their day and sorted there; a task writes one day after the other, line by line,
    and holds one day's text, which is one exchange's symbols."""
    lines = export_lines(df).withColumn("file_name", output_name(F.col("file_date"), F.lit(suffix)))
    spread = lines.repartition("file_name").sortWithinPartitions("file_name", "row_order")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, text = None, io.StringIO()
        for batch in batches:
            for row in batch[["file_name", *specs.UNIFIED]].itertuples(index=False, name=None):
                if row[0] != name:
                    if name is not None:
                        yield pd.DataFrame({"file_name": [name], "content": [text.getvalue()]})
                    name, text = row[0], io.StringIO()
                csv.writer(text, lineterminator="\n").writerow(["" if v is None else v for v in row[1:]])
        if name is not None:
            yield pd.DataFrame({"file_name": [name], "content": [text.getvalue()]})

    return spread.mapInPandas(run, "file_name string, content string")


def day_lines(df: DataFrame, suffix: str) -> DataFrame:
    """K1: -> file_name, line, row_order: the lines of headerless texts named YYYY-MM-DD<suffix>.txt."""
    return export_lines(df).select(output_name(F.col("file_date"), F.lit(suffix)).alias("file_name"), csv_line(specs.UNIFIED).alias("line"), "row_order")


def write_days(df: DataFrame, path: str, suffix: str) -> None:
    """K1 for a folder on a shared file system: one text per day, `YYYY-MM-DD<suffix>.txt`."""
    write_named(day_lines(df, suffix), path, ["row_order"])
