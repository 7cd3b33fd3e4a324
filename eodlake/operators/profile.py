"""Column profiles and narrow types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")
LIMITS = {"tinyint": 7, "smallint": 15, "int": 31}


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: rows, distinct values (null is one), their share, whether a dictionary pays (under
    half distinct), least and greatest number, and the narrowest integer type.

    One pass over `df` if counts may be approximate; else one per column, which reads that column only: several exact
    distinct counts in one aggregate would write every row once per column."""
    types = dict(df.dtypes)
    columns = columns or df.columns
    count = F.approx_count_distinct if approximate else F.countDistinct

    def of(c: str) -> Column:
        col = F.col(f"`{c}`")
        number = col if types[c] in INTEGERS else F.lit(None).cast("bigint")
        distinct = (count(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))).cast("bigint")
        return F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.count("*").alias("n_rows"), distinct.alias("n_distinct"), F.min(number).cast("bigint").alias("least"), F.max(number).cast("bigint").alias("greatest")
        )

    if approximate:
        out = df.agg(*[of(c).alias(f"c{i}") for i, c in enumerate(columns)])
        out = out.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r")).select("r.*")
    else:
        out = reduce(DataFrame.union, [df.agg(of(c).alias("r")).select("r.*") for c in columns])
    return _judged(out)


def _judged(out: DataFrame) -> DataFrame:
    """Whether a dictionary pays, and the narrowest integer type."""
    narrow = F.lit("bigint")
    for kind, bits in reversed(LIMITS.items()):
        narrow = F.when((F.col("least") >= -(1 << bits)) & (F.col("greatest") < (1 << bits)), F.lit(kind)).otherwise(narrow)
    return out.withColumn("use_dictionary", F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows") < 0.5).otherwise(F.lit(False))).withColumn(
        "narrow_type", F.when(F.col("least").isNotNull(), narrow)
    )


SKETCHES = "file_date date, column_name string, type string, n_rows bigint, n_null bigint, least bigint, greatest bigint, sketch binary"


def day_sketches(df: DataFrame, columns: list[str], day: str = "file_date") -> DataFrame:
    """A10 by day: -> SKETCHES, one row per day and column, in one pass; sketches of distinct values merge over days."""
    types = dict(df.dtypes)

    def of(c: str) -> Column:
        col = F.col(f"`{c}`")
        number = (col if types[c] in INTEGERS else F.lit(None)).cast("bigint")
        value = col.cast("bigint") if types[c] in INTEGERS else col.cast("string")
        return F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.count("*").alias("n_rows"), F.count_if(col.isNull()).alias("n_null"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.hll_sketch_agg(value).alias("sketch")
        )

    wide = df.groupBy(F.col(day).alias("file_date")).agg(*[of(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select("file_date", F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r")).select("file_date", "r.*")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """What `profile` gives, from day sketches: everything exact but `n_distinct`, which is within a sketch's error (about 2 %)."""
    n = F.hll_sketch_estimate(F.hll_union_agg("sketch")) + (F.sum("n_null") > 0).cast("bigint")
    out = sketches.groupBy("column_name", "type").agg(F.sum("n_rows").alias("n_rows"), n.alias("n_distinct"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return _judged(out)


def add_days(df: DataFrame, path: str, columns: list[str], day: str = "file_date") -> DataFrame:
    """Sketches of the days that `path` doesn't hold yet are added to it; -> all of them.  Days that are there (some thousand at most) are left out by a filter on
    the day, so folders and files of those days are not read again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        known = [r["file_date"] for r in spark.read.schema(SKETCHES).parquet(path).select("file_date").distinct().collect()]
        df = df.where(~F.coalesce(F.col(day).isin([d for d in known if d is not None]), F.lit(None in known)))
    day_sketches(df, columns, day).write.mode("append").parquet(path)
    return spark.read.schema(SKETCHES).parquet(path)


def narrow_integers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Integer columns cast to the narrowest type that holds them; floats stay."""
    columns = [c for c, t in df.dtypes if t in INTEGERS and (columns is None or c in columns)]
    if not columns:
        return df
    types = {r["column_name"]: r["narrow_type"] for r in profile(df.select(*[F.col(f"`{c}`") for c in columns]), approximate=True).collect()}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items() if t})


def files_with_rows(df: DataFrame) -> DataFrame:
    """Per day, the first line: a file is valid if it has one that could be read."""
    return df.groupBy("file_date").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"))
