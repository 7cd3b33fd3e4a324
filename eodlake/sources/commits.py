"""A lake that is appended to once (J10): data and completion markers.

A run writes its rows to a folder of its own below `data`, then one file of markers below `log`: a row per exchange, segment, day and source segment (a unit), with
the run and its number of rows.  Only marked units are read, each from one run, the first that has marked it; so

* a second run adds nothing: units with a marker are left out before any row is written, whatever the rows hold;
* a run that stops between data and marker has added nothing either; the next run writes its units again and `repair` deletes what is left;
* two runs at once may both write a unit, of which one counts.

The anti-join is on days and segments, a few thousand small rows a year, never on the rows of the lake.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = ("exchange", "segment", "file_date", "source_segment")
LOG = "exchange string, segment string, file_date date, source_segment string, run_id string, n_rows bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def markers(spark: SparkSession, lake: str) -> DataFrame:
    """-> LOG: the first run that has marked each unit.  Run ids begin with the time, so they sort by it."""
    if not _exists(spark, f"{lake}/log"):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(f"{lake}/log")
    return log.groupBy(*UNIT).agg(F.min(F.struct("run_id", "n_rows")).alias("first")).select(*UNIT, "first.*")


def _new_run() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def write_rows(df: DataFrame, lake: str, run_id: str) -> None:
    """The first half of an append: a run's rows, which nothing reads yet."""
    df.write.mode("errorifexists").parquet(f"{lake}/data/run_id={run_id}")


def write_markers(spark: SparkSession, lake: str, run_id: str) -> int:
    """The second half: the units that the run's written rows hold, as one file, which appears whole or not at all.  -> units."""
    rows = spark.read.parquet(f"{lake}/data/run_id={run_id}")
    units = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("run_id", F.lit(run_id))
    units = units.select(*[c.split()[0] for c in LOG.split(", ")])
    n = units.count()
    if n:
        units.coalesce(1).write.mode("append").parquet(f"{lake}/log")
    return n


def append_once(df: DataFrame, lake: str) -> int:
    """Rows of units that have no marker yet; -> the number of units added.  `df` has the columns of UNIT, and a unit comes whole."""
    spark, run_id = df.sparkSession, _new_run()
    done = markers(spark, lake).select(*UNIT)
    same = [F.col(f"_d_{c}").eqNullSafe(F.col(c)) for c in UNIT]
    new = df.join(done.toDF(*[f"_d_{c}" for c in UNIT]), same[0] & same[1] & same[2] & same[3], "left_anti")
    write_rows(new, lake, run_id)
    return write_markers(spark, lake, run_id)


def committed(spark: SparkSession, lake: str, schema: str) -> DataFrame:
    """The rows of marked units, each from the run that counts; `schema` as DDL, with the columns of UNIT."""
    log = markers(spark, lake).select(*[F.col(c).alias(f"_m_{c}") for c in UNIT], F.col("run_id").alias("_m_run"))
    if not _exists(spark, f"{lake}/data"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run_id string").parquet(f"{lake}/data")
    same = [F.col(f"_m_{c}").eqNullSafe(F.col(c)) for c in UNIT]
    return rows.join(log, same[0] & same[1] & same[2] & same[3] & (F.col("run_id") == F.col("_m_run")), "left_semi").drop("run_id")


def repair(spark: SparkSession, lake: str, older_than_seconds: float = 86_400) -> list[str]:
    """Delete the rows of runs that no marker names and that began long enough ago not to be running; -> their ids."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(lake).getFileSystem(spark._jsc.hadoopConfiguration())
    named = {r["run_id"] for r in spark.read.schema(LOG).parquet(f"{lake}/log").select("run_id").distinct().collect()} if _exists(spark, f"{lake}/log") else set()
    gone = []
    for folder in fs.globStatus(hadoop(f"{lake}/data/run_id=*")) or []:
        run_id = folder.getPath().getName().removeprefix("run_id=")
        if run_id not in named and time.time_ns() - int(run_id.split("-")[0]) >= older_than_seconds * 1e9:
            fs.delete(folder.getPath(), True)
            gone.append(run_id)
    return gone


def new_symbols(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """J10 by row: candidates whose day and symbol aren't stored yet; a null symbol is one like any other."""
    stored = existing.select(F.col("file_date").alias("_s_day"), F.col("symbol").alias("_s_symbol")).distinct()
    return candidates.join(stored, (F.col("file_date") == F.col("_s_day")) & F.col("symbol").eqNullSafe(F.col("_s_symbol")), "left_anti")
