"""Statistics of fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eodlake.functions.text import error_class, should_retry


def classify(log: DataFrame) -> DataFrame:
    """T5: failed fetches with class and whether to try again."""
    out = log.where("not success").withColumn("error_type", error_class(F.col("error_message")))
    return out.withColumn("should_retry", should_retry(F.col("error_type")))


def error_counts(log: DataFrame) -> DataFrame:
    return classify(log).groupBy("segment", "error_type", "should_retry").agg(F.count("*").alias("n_errors"))


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def fetch_stats(log: DataFrame) -> DataFrame:
    """Per segment; rates are 0 where there is nothing to divide by."""
    t = log.groupBy("segment").agg(
        F.count("*").alias("n_files"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("file_size"))), F.lit(0).cast("bigint")).alias("n_bytes"), F.round(F.sum("seconds"), 2).alias("seconds"),
        F.count_if(F.col("attempt") > 1).alias("n_retries"),
    )
    return t.select(
        "*", F.round(_per(F.col("n_bytes"), F.col("seconds")), 2).alias("bytes_per_second"), F.round(_per(F.col("n_ok"), F.col("seconds")), 4).alias("files_per_second"),
        F.round(_per(100 * F.col("n_ok"), F.col("n_files")), 4).alias("success_rate"),
    )


def completion(log: DataFrame) -> DataFrame:
    """Per day, how many of the segments tried were fetched."""
    per = log.groupBy("target_date", "segment").agg(F.bool_or("success").alias("ok"))
    n = per.groupBy("target_date").agg(F.count("*").alias("n_segments"), F.count_if("ok").alias("n_ok"))
    return n.withColumn("status", F.when(F.col("n_ok") == 0, "none").when(F.col("n_ok") == F.col("n_segments"), "all").otherwise("partial"))
