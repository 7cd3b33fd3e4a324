"""Segments of a day put together.

The result for a day is its equity rows and the enabled others, whatever order files arrived in and
however often it is computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.operators.normalize import KEYS, name

RANKS = {"EQ": 0, "SME": 1, "INDEX": 2}


def _values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows whose columns are all null or ''."""
    columns = columns or _values(df)
    filled = reduce(lambda a, b: a | b, [F.coalesce(name(c).cast("string"), F.lit("")) != "" for c in columns])
    return df.where(filled)


def align(df: DataFrame, base: DataFrame, strict_names: bool = False) -> DataFrame | None:
    """`df` in the columns of `base`.  As many columns: by position, unless `strict_names`.
    Otherwise by name, missing ones null, others dropped, empty rows dropped; None if no name is shared."""
    own, wanted = _values(df), _values(base)
    keys = [k for k in KEYS if k in df.columns]
    if own == wanted:
        return df
    types = dict(base.dtypes)
    if len(own) == len(wanted) and not strict_names:
        return df.select(*[name(a).cast(types[b]).alias(b) for a, b in zip(own, wanted, strict=True)], *keys)
    if not set(own) & set(wanted):
        return None
    matched = [c for c in wanted if c in own]
    aligned = df.select(*[(name(c) if c in own else F.lit(None)).cast(types[c]).alias(c) for c in wanted], *keys)
    return drop_empty_rows(aligned, matched)


def unified(df: DataFrame) -> DataFrame:
    """Seven columns to the unified names and types, by position."""
    kinds = [f.split() for f in specs.UNIFIED_SCHEMA.split(", ")]
    return df.select(*[name(a).cast(kind).alias(b) for a, (b, kind) in zip(_values(df), kinds, strict=True)], *[k for k in KEYS if k in df.columns])


def consolidate(exchange: str, eq: DataFrame, others: dict[str, DataFrame], enabled: set[str] | None = None) -> DataFrame:
    """Equity rows, then those of the other segments of days that have equity rows.

    A narrow union; only the equity days, one row each, are shuffled and broadcast to find the others' days.
    `source_rank` and `line_no` are the order inside a day (O3); `ordered` makes it a number."""
    days = F.broadcast(eq.select("file_date").distinct())
    # constants are given to each part: above the union Spark would leave them out of sort orders, and then sort again for folders of their values
    part = lambda df, s: unified(df).withColumns({"source_segment": F.lit(s), "exchange": F.lit(exchange), "segment": F.lit("EQ"), "source_rank": F.lit(RANKS.get(s)).cast("int")})
    out = part(eq, "EQ")
    for segment, df in others.items():
        if enabled is not None and segment not in enabled:
            continue
        out = out.unionByName(part(df.join(days, "file_date", "left_semi"), segment))
    return out


def ordered(df: DataFrame) -> DataFrame:
    """O3: `row_order` in a day: equity by symbol (nulls last), then the other segments in file order."""
    from pyspark.sql import Window

    symbol = F.when(F.col("source_rank") == 0, F.col("symbol"))
    order = Window.partitionBy("exchange", "segment", "file_date").orderBy("source_rank", F.asc_nulls_last(symbol), "line_no")
    return df.withColumn("row_order", F.row_number().over(order).cast("bigint"))


def ordered_by_month(df: DataFrame, month: str = "file_month") -> DataFrame:
    """`ordered`, with rows dealt out by month: one shuffle serves the order in the days and folders of months, which are written from where the rows are.

    Only the month deals them: an exchange that is the same in all rows is a constant, which Spark leaves out of the order's keys but not out of
    those of a shuffle, and would then shuffle once more."""
    from pyspark.sql import Window

    keyed = df.withColumn(month, F.date_format("file_date", "yyyy-MM")).repartition(month)
    symbol = F.when(F.col("source_rank") == 0, F.col("symbol"))
    order = Window.partitionBy("exchange", "segment", month, "file_date").orderBy("source_rank", F.asc_nulls_last(symbol), "line_no")
    return keyed.withColumn("row_order", F.row_number().over(order).cast("bigint"))


def days_with(df: DataFrame, sentinel: str = specs.SENTINEL, symbol: str = "symbol") -> DataFrame:
    """Days where a symbol contains the sentinel."""
    return df.where(name(symbol).contains(sentinel)).select("file_date").distinct()


def not_yet_appended(candidates: DataFrame, existing: DataFrame, sentinel: str = specs.SENTINEL) -> DataFrame:
    """Candidate rows of days whose stored rows don't hold the sentinel yet."""
    return candidates.join(days_with(existing, sentinel), "file_date", "left_anti")


def rows_per_day(df: DataFrame) -> DataFrame:
    """A9."""
    return df.groupBy("exchange", "source_segment", "file_date").agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))


def segments_per_day(df: DataFrame) -> DataFrame:
    """The segments that a day has rows of."""
    return df.groupBy("exchange", "file_date").agg(F.concat_ws(",", F.array_sort(F.collect_set("source_segment"))).alias("segments"), F.countDistinct("source_segment").alias("n_segments"))
