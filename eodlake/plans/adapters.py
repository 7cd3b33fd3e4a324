"""Test tables as raw segments: each adapter as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.operators import calendar as cal_ops

HOLIDAYS = [date(1996, 1, 26), date(1996, 8, 15), date(1997, 10, 2), date(1998, 12, 25), date(1999, 1, 26), date(2000, 5, 1), date(2000, 8, 15), date(2001, 1, 26), date(2024, 1, 1), date(2024, 1, 22), date(2024, 1, 26)]
CAL = (date(1995, 1, 1), date(2002, 1, 31))
EVENT_CAL = (date(2023, 12, 15), date(2024, 2, 15))
EXPECTED = date(2001, 8, 10)
AS_OF = datetime(2001, 8, 10, 17, 30)
DENIED = ["SYM7", "SYM11", "SYM150"]
FILE_SUFFIXES = ["-NSE-EQ", "-NSE-FO", "-NSE-SME", "-NSE-INDEX", "-BSE-EQ", "-BSE-INDEX"]
SEGMENT_NAMES = ["NSE_EQ", "NSE_FO", "NSE_SME", "NSE_INDEX", "BSE_EQ", "BSE_INDEX"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.when(k % 101 == 0, "bad").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("TradDt"),
        F.when(k % 97 != 0, F.concat(F.lit("SYM"), k.cast("string"))).alias("TckrSymb"),
        F.col("l_returnflag").alias("_flag"), F.col("l_linestatus").alias("_status"),
        F.col("l_extendedprice").alias("OpnPric"), F.col("l_tax").alias("HghPric"), F.col("l_discount").alias("LwPric"), F.col("l_extendedprice").alias("ClsPric"),
        F.col("l_quantity").cast("bigint").alias("TtlTradgVol"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("FinInstrmId"), F.lit("x").alias("Rmks"), F.lit("CM").alias("Sgmt"),
        day.alias("file_date"), (F.col("l_orderkey") * 10_000_000 + k * 8 + F.col("l_linenumber")).alias("line_no"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def raw_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.when(F.col("_flag") == "A", "EQ").when(F.col("_flag") == "N", "BE").otherwise("SM")
    return _equity(spark, sf_dir).withColumn("SctySrs", series).drop("_flag", "_status", *LINE_KEYS)


def raw_bse(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.when(F.col("_flag") == "A", "A").when(F.col("_flag") == "N", "XT").otherwise("G")
    return _equity(spark, sf_dir).withColumn("SctySrs", series).drop("_flag", "_status", *LINE_KEYS)


def raw_fo(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "STF").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "IDF")
    expiry = F.date_format("l_shipdate", "yyyy-MM-dd")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    odd = F.col("l_orderkey") % 103
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 89 != 0, F.concat(F.lit("SUP"), F.col("l_suppkey").cast("string"))).alias("TckrSymb"),
        F.date_format(month, "yyyy-MM-dd").alias("TradDt"),
        F.when(odd == 0, "not a date").when(odd != 1, expiry).alias("XpryDt"),
        F.when(F.col("l_returnflag") == "N", F.lit("IDF")).otherwise(F.coalesce(kind, F.lit("STO"))).alias("FinInstrmTp"),
        F.col("l_extendedprice").alias("OpnPric"), F.col("l_tax").alias("HghPric"), F.col("l_discount").alias("LwPric"), F.col("l_extendedprice").alias("ClsPric"),
        F.col("l_quantity").cast("bigint").alias("TtlTradgVol"), month.alias("file_date"), *LINE_KEYS,
    )


FO_TIES = (*LINE_KEYS, "OpnPric")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("file_date", F.col("o_orderdate").cast("date")).withColumn("line_no", F.col("o_orderkey"))


def raw_sme(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _orders(spark, sf_dir).select(
        F.lit("N").alias("MARKET"), F.lit("SM").alias("SERIES"), F.when(F.col("o_custkey") % 53 != 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("SYMBOL"),
        price.alias("OPEN_PRICE"), price.alias("HIGH_PRICE"), price.alias("LOW_PRICE"), price.alias("CLOSE_PRICE"), (F.col("o_custkey") % 1000).alias("NET_TRDQTY"), "file_date", "line_no",
    )


def raw_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    stated = F.when(F.col("o_orderkey") % 5 == 0, "wrong").otherwise(F.date_format("file_date", "dd-MM-yyyy"))
    return _orders(spark, sf_dir).select(
        F.col("o_orderpriority").alias("Index Name"), stated.alias("Index Date"), price.alias("Open Index Value"), price.alias("High Index Value"), price.alias("Low Index Value"), price.alias("Closing Index Value"),
        F.lit("1").alias("P/E"), F.col("o_custkey").alias("Volume"), "file_date", "line_no",
    )


def raw_bidx(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _orders(spark, sf_dir).select(
        F.when(F.col("o_custkey") % 7 == 0, specs.SENTINEL).otherwise(F.col("o_orderpriority")).alias("IndexName"), F.lit("c").alias("IndexCode"),
        price.alias("OpenPrice"), price.alias("HighPrice"), price.alias("LowPrice"), price.alias("ClosePrice"), "file_date", "line_no",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files: some names or dates are bad, some files empty; NSE-SME has none that is valid."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    suffix = F.element_at(F.array(*map(F.lit, FILE_SUFFIXES)), (c % 6 + 1).cast("int"))
    day = F.when((k % 31 == 0) | (c % 6 == 2), "2001-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ext = F.when(k % 2 == 0, ".txt").when(k % 17 == 0, ".zip").otherwise(".csv")
    return table(spark, sf_dir, "orders").select(F.concat(day, suffix, ext).alias("file_name"), F.when(k % 211 == 0, 0).otherwise(k).cast("bigint").alias("length"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    texts = ["Timeout after 5 s", "Connection refused", "HTTP 503", "404 Not Found", "403 Forbidden", "SSL error", "Timeout on network", "", "odd"]
    message = F.when(i % 10 == 9, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, texts)), (i % 10 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(
        F.element_at(F.array(*map(F.lit, SEGMENT_NAMES)), (F.col("user_id") % 6 + 1).cast("int")).alias("segment"), F.to_date("ts").alias("target_date"), (i % 3 + 1).cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("success"), (F.col("user_id") * 1000).alias("file_size"), F.when(F.col("event_type") == "error", message).alias("error_message"), F.col("value").alias("seconds"), "event_id",
    )


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in HOLIDAYS], "holiday date")


def cal(spark: SparkSession, span: tuple[date, date] = CAL, **flags: bool) -> DataFrame:
    return cal_ops.calendar(spark, *span, holidays(spark), **flags)


# The same in SQL.

_EQ = """
  CASE WHEN l_partkey % 101 = 0 THEN 'bad' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS TradDt,
  CASE WHEN l_partkey % 97 <> 0 THEN 'SYM' || l_partkey END AS TckrSymb,
  l_extendedprice AS OpnPric, l_tax AS HghPric, l_discount AS LwPric, l_extendedprice AS ClsPric, l_quantity::BIGINT AS TtlTradgVol,
  l_shipdate::DATE AS file_date, l_orderkey * 10000000 + l_partkey * 8 + l_linenumber AS line_no"""
RAW_CM = f"raw_cm AS (SELECT CASE l_returnflag WHEN 'A' THEN 'EQ' WHEN 'N' THEN 'BE' ELSE 'SM' END AS SctySrs, {_EQ} FROM lineitem)"
RAW_BSE = f"raw_bse AS (SELECT CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'XT' ELSE 'G' END AS SctySrs, {_EQ} FROM lineitem)"
RAW_FO = """raw_fo AS (SELECT
  CASE WHEN l_partkey % 89 <> 0 THEN 'SUP' || l_suppkey END AS TckrSymb,
  strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS TradDt,
  CASE l_orderkey % 103 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS XpryDt,
  CASE WHEN l_returnflag = 'N' THEN 'IDF' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'STF' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'IDF' ELSE 'STO' END AS FinInstrmTp,
  l_extendedprice AS OpnPric, l_tax AS HghPric, l_discount AS LwPric, l_extendedprice AS ClsPric, l_quantity::BIGINT AS TtlTradgVol,
  date_trunc('month', l_shipdate)::DATE AS file_date, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
RAW_SME = """raw_sme AS (SELECT CASE WHEN o_custkey % 53 <> 0 THEN 'C' || o_custkey END AS SYMBOL, o_totalprice AS p, o_custkey % 1000 AS NET_TRDQTY,
  o_orderdate::DATE AS file_date, o_orderkey AS line_no FROM orders)"""
RAW_IDX = """raw_idx AS (SELECT o_orderpriority AS IndexName, CASE WHEN o_orderkey % 5 = 0 THEN 'wrong' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS stated, o_totalprice AS p, o_custkey AS Volume,
  o_orderdate::DATE AS file_date, o_orderkey AS line_no FROM orders)"""
RAW_BIDX = """raw_bidx AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN 'BSE SENSEX' ELSE o_orderpriority END AS IndexName, o_totalprice AS p,
  o_orderdate::DATE AS file_date, o_orderkey AS line_no FROM orders)"""
FILES = """files AS (SELECT
  CASE WHEN o_orderkey % 31 = 0 OR o_custkey % 6 = 2 THEN '2001-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  || ['-NSE-EQ', '-NSE-FO', '-NSE-SME', '-NSE-INDEX', '-BSE-EQ', '-BSE-INDEX'][o_custkey % 6 + 1]
  || CASE WHEN o_orderkey % 2 = 0 THEN '.txt' WHEN o_orderkey % 17 = 0 THEN '.zip' ELSE '.csv' END AS file_name,
  CASE WHEN o_orderkey % 211 = 0 THEN 0 ELSE o_orderkey END AS length FROM orders)"""
STORED = FILES + r""", stored AS (SELECT file_name, regexp_extract(file_name, '^(\d{4}-\d{2}-\d{2})-([A-Z]+)-([A-Z]+)\.(txt|csv)', 2) AS exchange,
  regexp_extract(file_name, '^(\d{4}-\d{2}-\d{2})-([A-Z]+)-([A-Z]+)\.(txt|csv)', 3) AS segment,
  try_strptime(regexp_extract(file_name, '^(\d{4}-\d{2}-\d{2})-', 1), '%Y-%m-%d')::DATE AS file_date, length
  FROM files WHERE regexp_matches(file_name, '^(\d{4}-\d{2}-\d{2})-([A-Z]+)-([A-Z]+)\.(txt|csv)'))"""
SEGS = "segs(exchange, segment, name, base_url, filename_pattern, fmt, file_suffix, available_from, timeout_absent, critical) AS (VALUES " + ", ".join(
    f"('{s.exchange}', '{s.segment}', '{s.name}', '{s.base_url}', '{s.filename_pattern}', '{ {'yyyyMMdd': '%Y%m%d', 'ddMMyy': '%d%m%y', 'ddMMyyyy': '%d%m%Y'}[s.date_format] }', '{s.file_suffix}', "
    + (f"DATE '{s.available_from}'" if s.available_from else "NULL::DATE")
    + f", {str(s.timeout_means_absent).lower()}, {str(s.critical).lower()})"
    for s in specs.SEGMENTS.values()
) + ")"
FETCH_LOG = """fetch_log AS (SELECT ['NSE_EQ', 'NSE_FO', 'NSE_SME', 'NSE_INDEX', 'BSE_EQ', 'BSE_INDEX'][user_id % 6 + 1] AS segment, ts::DATE AS target_date, (event_id % 3 + 1)::INT AS attempt,
  event_type <> 'error' AS success, user_id * 1000 AS file_size,
  CASE WHEN event_type = 'error' AND event_id % 10 <> 9 THEN ['Timeout after 5 s', 'Connection refused', 'HTTP 503', '404 Not Found', '403 Forbidden', 'SSL error', 'Timeout on network', '', 'odd'][event_id % 10 + 1] END AS error_message,
  value AS seconds, event_id FROM events)"""


def cal_sql(span: tuple[date, date] = CAL, pad: int = cal_ops.PAD) -> str:
    days = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)
    return f"""c0 AS (SELECT unnest(generate_series(DATE '{span[0]}' - INTERVAL {pad} DAY, DATE '{span[1]}' + INTERVAL {pad} DAY, INTERVAL 1 DAY))::DATE AS d),
c1 AS (SELECT d, isodow(d) >= 6 AS is_weekend, d IN ({days}) AS is_holiday, isodow(d) < 6 AND d NOT IN ({days}) AS is_trading FROM c0),
cal AS (SELECT *, sum(is_trading::INT) OVER (ORDER BY d)::BIGINT AS trading_idx,
  max(CASE WHEN is_trading THEN d END) OVER (ORDER BY d) AS last_trading_day,
  min(CASE WHEN is_trading THEN d END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading_day FROM c1)"""
