"""Files as they arrive (ST1-ST4): months touched by a batch are computed anew from all that has arrived.

Arrivals are stored as normalised rows by batch, so a batch that comes twice changes nothing, a late
file belongs to its own day, and no state has to be kept or cleaned up.

Of a day and segment that came more than once, the last delivery counts.  What belongs to one delivery is told by a column `delivery`, a number that
grows: its rows may come in several batches.  Rows without one are a delivery per batch, so a day and segment must then come whole in one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eodlake import specs
from eodlake.operators import append, normalize
from eodlake.sources import readers, sinks

SCHEMA = "symbol string, trade_date string, open double, high double, low double, close double, volume double, file_date date, line_no bigint, source_segment string"


def land(batch: DataFrame, landed: str, batch_id: int) -> None:
    """A batch's months are folders; the same batch again replaces them."""
    numbered = batch.withColumn("file_month", sinks.month_of(F.col("file_date"))).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if "delivery" not in batch.columns:
        numbered = numbered.withColumn("delivery", F.col("batch_id"))
    # rows of a month come together, or each task would write a file for each of its months
    dealt = numbered.hint("rebalance", F.col("file_month"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_month", "batch_id").parquet(landed)


def _landed(spark: SparkSession, landed: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, delivery bigint, file_month string, batch_id bigint").parquet(landed)


def consolidate_months(spark: SparkSession, exchange: str, landed: str, lake: str, months: list[str], enabled: set[str] | None = None) -> None:
    """Rewrite the lake's folders of these months from what has landed, of which only these months' folders are read; of a day and segment
    that came more than once, the last delivery counts, whatever batches its rows came in."""
    rows = _landed(spark, landed).where(F.col("file_month").isin(months)).drop("file_month")
    rows = rows.withColumn("delivery", F.coalesce("delivery", "batch_id")).drop("batch_id")
    last = F.broadcast(rows.groupBy("file_date", "source_segment").agg(F.max("delivery").alias("delivery")))
    rows = rows.join(last, ["file_date", "source_segment", "delivery"], "left_semi").drop("delivery")
    part = lambda s: rows.where(F.col("source_segment") == s).drop("source_segment")
    out = append.consolidate(exchange, part("EQ"), {s: part(s) for s in ("SME", "INDEX")}, enabled)
    sinks.write_ordered(out, lake)


def _take_in(rows: DataFrame, batch_id: int, exchange: str, landed: str, lake: str, enabled: set[str] | None) -> None:
    """A batch's rows land, and its months are computed anew."""
    spark = rows.sparkSession
    if rows.isEmpty():
        return
    land(rows, landed, batch_id)
    came = _landed(spark, landed).where(F.col("batch_id") == batch_id).select("file_month").distinct()
    consolidate_months(spark, exchange, landed, lake, [r["file_month"] for r in came.collect()], enabled)


def stream_consolidate(arrivals: DataFrame, exchange: str, landed: str, lake: str, checkpoint: str, normalize: Callable[[DataFrame], DataFrame] | None = None, enabled: set[str] | None = None) -> StreamingQuery:
    """Run over all that is there and end.  `arrivals`: a stream of SCHEMA (or of what `normalize` turns into it), with a column
    `delivery bigint` where a day and segment may be cut to several files.  A month is computed anew in each batch that has rows of it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _take_in(normalize(batch) if normalize else batch, batch_id, exchange, landed, lake, enabled)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is consolidated of an exchange, by segment.
CONSOLIDATED = {"NSE": ["NSE_EQ", "NSE_SME", "NSE_INDEX"], "BSE": ["BSE_EQ", "BSE_INDEX"]}
FILES = "path string, modificationTime timestamp, length bigint, content binary"
QUARANTINE = "file_name string, file_date date, reason string, batch_id bigint"


def normalized(parsed: DataFrame, exchange: str, sme_suffix: bool = True, denied: list[str] | DataFrame | None = None) -> DataFrame:
    """What `parse_segments` gives, each segment by its own rules -> rows of SCHEMA."""
    rules = normalize.NORMALIZERS | {"NSE_SME": lambda df: normalize.sme(df, sme_suffix), "BSE_EQ": lambda df: normalize.bse_eq(df, denied)}
    parts = []
    for name in CONSOLIDATED[exchange]:
        spec = specs.SEGMENTS[name]
        rows = append.unified(rules[name](readers.of_segment(parsed, spec)))
        parts.append(rows.withColumn("source_segment", F.lit(spec.segment)))
    return reduce(DataFrame.unionByName, parts)


def take_in_files(
    files: DataFrame, batch_id: int, exchange: str, landed: str, lake: str, quarantine: str, enabled: set[str] | None = None, sme_suffix: bool = True, denied: list[str] | DataFrame | None = None
) -> None:
    """Raw files (file_name, content) from archive to lake: those that can be read land and their months are computed anew, those that can't
    are written to the quarantine with the reason.  The same batch again replaces what it has written."""
    # one pass over the archives serves the segments' rules and the quarantine; lost parts are parsed again
    parsed = readers.parse_segments(files, [specs.SEGMENTS[n] for n in CONSOLIDATED[exchange]]).persist(StorageLevel.DISK_ONLY)
    try:
        bad = readers.bad(parsed).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(quarantine)
        _take_in(normalized(parsed, exchange, sme_suffix, denied), batch_id, exchange, landed, lake, enabled)
    finally:
        parsed.unpersist()


def stream_archives(
    spark: SparkSession,
    folder: str,
    exchange: str,
    landed: str,
    lake: str,
    quarantine: str,
    checkpoint: str,
    files_per_batch: int = 5000,
    enabled: set[str] | None = None,
    sme_suffix: bool = True,
    denied: list[str] | None = None,
) -> StreamingQuery:
    """ST1, S1: raw files of all segments of an exchange, zipped and plain, as they arrive below `folder` in any order and any folders; runs over all that is
    there and ends.

    The stream is of whole files, which tasks open one by one.  Each file is taken once, by its path; a file that comes again (a damaged one
    anew) needs another path, and of a day and segment the last batch counts.  A damaged file costs only itself: its day waits for another one."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    named = arriving.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def each(batch: DataFrame, batch_id: int) -> None:
        take_in_files(batch, batch_id, exchange, landed, lake, quarantine, enabled, sme_suffix, denied)

    return named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(
    spark: SparkSession, folder: str, exchange: str, landed: str, lake: str, quarantine: str, batch_id: int = 0, enabled: set[str] | None = None, sme_suffix: bool = True, denied: list[str] | DataFrame | None = None
) -> None:
    """All raw files of an exchange's segments below `folder`, from archive to lake in one batch; files without a byte are quarantined too.
    A later batch needs a higher number, as of a day and segment the last one counts; the same number again replaces its batch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    empty = readers.empty_files(spark, folder, recursive=True).select("file_name", F.lit(b"").alias("content"))
    take_in_files(named.unionByName(empty), batch_id, exchange, landed, lake, quarantine, enabled, sme_suffix, denied)


def quarantined(spark: SparkSession, quarantine: str, folder: str | None = None) -> DataFrame:
    """-> file_name, file_date, reason of files that could not be read; with `folder`, also of files without a byte, which a stream passes over."""
    stored = spark.read.schema(QUARANTINE).parquet(quarantine).drop("batch_id")
    if folder is None:
        return stored
    empty = readers.empty_files(spark, folder, recursive=True).select("file_name")
    every = list(specs.SEGMENTS.values())
    day = F.coalesce(*[readers.raw_name_date(F.col("file_name"), s.raw_name, s.date_format) for s in every])
    return stored.unionByName(empty.select("file_name", day.alias("file_date"), F.lit("empty file").alias("reason"))).distinct()
