"""Queries over the test tables: each applies library operators to an adapter, with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions.dates import compact, data_available, date_in_name, in_market_hours, lenient_date, raw_name_date
from eodlake.functions.text import money
from eodlake.operators import append, calendar, contracts, coverage, fetchlog, normalize, planning, profile
from eodlake.plans import adapters as a
from eodlake.sources import commits, named, readers, segments, sinks
from eodlake.sources.scratch import shared_folder
from eodlake.streaming import arrivals, waiting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Without the keys that only serve the order."""
    return df.drop("line_no")


_D1 = "strftime(try_strptime(TradDt, '%Y-%m-%d'), '%Y%m%d')"
_EQ_COLS = f"TckrSymb, {_D1} AS TradDt, OpnPric, HghPric, LwPric, ClsPric, TtlTradgVol, file_date"


@query(f"WITH {a.RAW_CM} SELECT {_EQ_COLS} FROM raw_cm WHERE SctySrs IN ('EQ', 'BE', 'BZ')")
def normalize_nse_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.nse_eq(a.raw_cm(spark, sf_dir)))


@query(f"WITH {a.RAW_BSE} SELECT {_EQ_COLS} FROM raw_bse WHERE SctySrs IN ('A','B','M','MS','MT','P','R','T','W','X','XT','Z','ZP') AND (TckrSymb IS NULL OR TckrSymb NOT IN ('SYM7', 'SYM11', 'SYM150'))")
def normalize_bse_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.bse_eq(a.raw_bse(spark, sf_dir), a.DENIED))


@query(SQL["normalize_bse_eq"])
def normalize_bse_eq_denied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the denied symbols as a table."""
    denied = spark.createDataFrame([(s,) for s in a.DENIED], "symbol string")
    return _plain(normalize.bse_eq(a.raw_bse(spark, sf_dir), denied))


_SME = "SELECT {} AS SYMBOL, strftime(file_date, '%Y%m%d') AS \"DATE\", p AS OPEN_PRICE, p AS HIGH_PRICE, p AS LOW_PRICE, p AS CLOSE_PRICE, NET_TRDQTY, file_date FROM raw_sme"


@query(f"WITH {a.RAW_SME} {_SME.format('SYMBOL')}")
def normalize_sme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.sme(a.raw_sme(spark, sf_dir)))


@query(f"WITH {a.RAW_SME} " + _SME.format("SYMBOL || '_SME'"))
def normalize_sme_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.sme(a.raw_sme(spark, sf_dir), suffix=True))


@query(f"WITH {a.RAW_IDX} SELECT IndexName AS index_name, strftime(file_date, '%Y%m%d') AS index_date, p AS open, p AS high, p AS low, p AS close, Volume AS volume, file_date FROM raw_idx")
def normalize_nse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.nse_index(a.raw_idx(spark, sf_dir))).toDF("index_name", "index_date", "open", "high", "low", "close", "volume", "file_date")


@query(f"WITH {a.RAW_BIDX} SELECT IndexName, strftime(file_date, '%Y%m%d') AS \"Date\", p AS OpenPrice, p AS HighPrice, p AS LowPrice, p AS ClosePrice, 0::BIGINT AS Volume, file_date FROM raw_bidx")
def normalize_bse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.bse_index(a.raw_bidx(spark, sf_dir)))


_FUT = "FinInstrmTp IN ('STF', 'IDF') AND TckrSymb IS NOT NULL AND (XpryDt IS NULL OR try_strptime(XpryDt, '%Y-%m-%d') IS NOT NULL)"


@query(
    f"""WITH {a.RAW_FO}, n AS (
  SELECT *, row_number() OVER (PARTITION BY file_date, TckrSymb ORDER BY try_strptime(XpryDt, '%Y-%m-%d') NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, OpnPric) AS n
  FROM raw_fo WHERE {_FUT})
SELECT TckrSymb || '-' || repeat('M', (n // 1000)::INT)
  || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1]
  || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS SYMBOL_NEW,
  {_D1} AS TradDt, OpnPric, HghPric, LwPric, ClsPric, TtlTradgVol, file_date FROM n"""
)
def fut_roman_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.nse_fo(a.raw_fo(spark, sf_dir), a.FO_TIES).drop(*a.LINE_KEYS)


@query(
    f"""WITH {a.RAW_FO} SELECT file_date, CASE WHEN TckrSymb IS NULL THEN 'no ticker' ELSE 'bad expiry' END AS reason, count(*) AS n_rows
FROM raw_fo WHERE FinInstrmTp IN ('STF', 'IDF') AND NOT ({_FUT}) GROUP BY ALL"""
)
def fut_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.quarantine(a.raw_fo(spark, sf_dir)).groupBy("file_date", "reason").agg(F.count("*").alias("n_rows"))


_UNI_EQ = f"SELECT TckrSymb AS symbol, {_D1} AS trade_date, OpnPric AS open, HghPric AS high, LwPric AS low, ClsPric AS close, TtlTradgVol::DOUBLE AS volume, file_date, line_no, 'EQ' AS source_segment"
_NSE = f"""{a.RAW_CM}, {a.RAW_SME}, {a.RAW_IDX},
eq AS ({_UNI_EQ} FROM raw_cm WHERE SctySrs IN ('EQ', 'BE', 'BZ')), dy AS (SELECT DISTINCT file_date FROM eq),
alls AS (SELECT * FROM eq
  UNION ALL SELECT SYMBOL || '_SME', strftime(file_date, '%Y%m%d'), p, p, p, p, NET_TRDQTY::DOUBLE, file_date, line_no, 'SME' FROM raw_sme WHERE file_date IN (SELECT file_date FROM dy)
  UNION ALL SELECT IndexName, strftime(file_date, '%Y%m%d'), p, p, p, p, Volume::DOUBLE, file_date, line_no, 'INDEX' FROM raw_idx WHERE file_date IN (SELECT file_date FROM dy)),
cons AS (SELECT symbol, trade_date, open, high, low, close, volume, file_date, line_no, source_segment, 'NSE' AS exchange, 'EQ' AS segment, CASE source_segment WHEN 'EQ' THEN 0 WHEN 'SME' THEN 1 ELSE 2 END AS source_rank FROM alls)"""


def _nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = {"SME": normalize.sme(a.raw_sme(spark, sf_dir), suffix=True), "INDEX": normalize.nse_index(a.raw_idx(spark, sf_dir))}
    return append.consolidate("NSE", normalize.nse_eq(a.raw_cm(spark, sf_dir)), others)


def _bse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.consolidate("BSE", normalize.bse_eq(a.raw_bse(spark, sf_dir), a.DENIED), {"INDEX": normalize.bse_index(a.raw_bidx(spark, sf_dir))})


@query(f"WITH {_NSE} SELECT * EXCLUDE (line_no) FROM cons")
def consolidate_nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a whole history of equities with small companies and indices of the same days."""
    return _plain(_nse(spark, sf_dir))


@query(f"WITH {_NSE} SELECT * EXCLUDE (line_no) FROM cons WHERE source_segment <> 'SME'")
def consolidate_nse_without_sme(spark: SparkSession, sf_dir: str) -> DataFrame:
    eq, idx = normalize.nse_eq(a.raw_cm(spark, sf_dir)), normalize.nse_index(a.raw_idx(spark, sf_dir))
    return _plain(append.consolidate("NSE", eq, {"SME": normalize.sme(a.raw_sme(spark, sf_dir)), "INDEX": idx}, enabled={"INDEX"}))


_BSE = f"""{a.RAW_BSE}, {a.RAW_BIDX},
eq AS ({_UNI_EQ} FROM raw_bse WHERE SctySrs IN ('A','B','M','MS','MT','P','R','T','W','X','XT','Z','ZP') AND (TckrSymb IS NULL OR TckrSymb NOT IN ('SYM7', 'SYM11', 'SYM150'))),
cons AS (SELECT *, 'BSE' AS exchange, 'EQ' AS segment, CASE source_segment WHEN 'EQ' THEN 0 ELSE 2 END AS source_rank FROM (SELECT * FROM eq
  UNION ALL SELECT IndexName, strftime(file_date, '%Y%m%d'), p, p, p, p, 0::DOUBLE, file_date, line_no, 'INDEX' FROM raw_bidx WHERE file_date IN (SELECT file_date FROM eq)))"""


@query(f"WITH {_BSE} SELECT * EXCLUDE (line_no) FROM cons")
def consolidate_bse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_bse(spark, sf_dir))


@query(
    f"""WITH {_NSE} SELECT exchange, segment, file_date, source_segment, symbol, line_no,
row_number() OVER (PARTITION BY file_date ORDER BY source_rank, CASE WHEN source_rank = 0 THEN symbol END NULLS LAST, line_no) AS row_order FROM cons"""
)
def append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.ordered(_nse(spark, sf_dir)).select("exchange", "segment", "file_date", "source_segment", "symbol", "line_no", "row_order")


@query(
    f"""WITH {a.RAW_BIDX} SELECT IndexName AS symbol, p AS close, file_date FROM raw_bidx
WHERE line_no % 2 = 0 AND file_date NOT IN (SELECT file_date FROM raw_bidx WHERE line_no % 2 = 1 AND contains(IndexName, 'BSE SENSEX'))"""
)
def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the index rows are stored; of the others only those of days without the sentinel are new."""
    rows = append.unified(normalize.bse_index(a.raw_bidx(spark, sf_dir)))
    return append.not_yet_appended(rows.where("line_no % 2 = 0"), rows.where("line_no % 2 = 1")).select("symbol", "close", "file_date")


@query(
    f"""WITH {a.RAW_SME} SELECT CASE WHEN line_no % 5 <> 0 THEN SYMBOL END AS SYMBOL, NULL::VARCHAR AS "DATE", NULL::DOUBLE AS OPEN_PRICE, NULL::DOUBLE AS HIGH_PRICE, NULL::DOUBLE AS LOW_PRICE,
CASE WHEN line_no % 5 <> 0 THEN p END AS CLOSE_PRICE, NULL::BIGINT AS NET_TRDQTY, file_date FROM raw_sme WHERE line_no % 5 <> 0"""
)
def align_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = normalize.sme(a.raw_sme(spark, sf_dir))
    some = F.col("line_no") % 5 != 0
    narrow = base.select(F.when(some, F.col("SYMBOL")).alias("SYMBOL"), F.when(some, F.col("CLOSE_PRICE")).alias("CLOSE_PRICE"), F.lit("x").alias("other"), "file_date", "line_no")
    return _plain(append.align(narrow, base))


@query(f"WITH {a.RAW_BIDX} SELECT IndexName AS SYMBOL, strftime(file_date, '%Y%m%d') AS \"DATE\", p AS OPEN_PRICE, p AS HIGH_PRICE, p AS LOW_PRICE, p AS CLOSE_PRICE, 0::BIGINT AS NET_TRDQTY, file_date FROM raw_bidx")
def align_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(append.align(normalize.bse_index(a.raw_bidx(spark, sf_dir)), normalize.sme(a.raw_sme(spark, sf_dir))))


@query(
    f"""WITH {a.RAW_CM} SELECT file_date, count(*) AS n_rows, count(*) FILTER (try_strptime(TradDt, '%Y-%m-%d') IS NULL AND TradDt IS NOT NULL) AS n_bad,
count(*) FILTER (TradDt IS NULL) AS n_missing, count(*) FILTER (try_strptime(TradDt, '%Y-%m-%d')::DATE <> file_date) AS n_other_day FROM raw_cm GROUP BY file_date"""
)
def date_parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.date_quality(a.raw_cm(spark, sf_dir))


@query(
    f"""WITH {a.RAW_IDX} SELECT file_date, count(*) AS n_rows, count(*) FILTER (try_strptime(stated, '%d-%m-%Y') IS NULL AND stated IS NOT NULL) AS n_bad,
count(*) FILTER (stated IS NULL) AS n_missing, count(*) FILTER (try_strptime(stated, '%d-%m-%Y')::DATE <> file_date) AS n_other_day FROM raw_idx GROUP BY file_date"""
)
def index_date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.date_quality(a.raw_idx(spark, sf_dir), "Index Date", "dd-MM-yyyy")


_RANGES = "SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_custkey % 12)::INT - 2)::DATE AS e FROM orders"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return a.table(spark, sf_dir, "orders").select("o_orderkey", day.alias("s"), F.date_add(day, (F.col("o_custkey") % 12 - 2).cast("int")).alias("e"), (F.col("o_custkey") % 9 - 2).cast("int").alias("n"))


@query(f"WITH {a.cal_sql()}, r AS ({_RANGES}) SELECT o_orderkey, s, e, d FROM r JOIN cal ON d BETWEEN s AND e AND is_trading")
def trading_days_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _ranges(spark, sf_dir).drop("n")
    return calendar.trading_days(ranges, calendar.calendar_for(ranges, ["s", "e"], a.holidays(spark)), "s", "e").select("o_orderkey", "s", "e", "d")


@query(
    f"""WITH {a.cal_sql()}, m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT month, n_orders, (SELECT count(*) FROM cal WHERE is_trading AND d >= month AND d <= last_day(month)) AS n_trading_days FROM m"""
)
def month_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days of each month that has orders."""
    months = a.table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n_orders"))
    return calendar.days_of_months(months, a.cal(spark), "month").groupBy("month", "n_orders").agg(F.count("d").alias("n_trading_days"))


@query(f"WITH {a.cal_sql()} SELECT o_orderkey, d AS day, last_trading_day, next_trading_day FROM orders JOIN cal ON d = o_orderdate::DATE")
def last_next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, cal = a.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), a.cal(spark)
    return calendar.with_next_trading_day(calendar.with_last_trading_day(days, cal, "day"), cal, "day")


@query(
    f"""WITH {a.cal_sql()}, r AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_custkey % 9 - 2)::INT AS n FROM orders)
SELECT o_orderkey, s, n, CASE WHEN n <= 0 THEN s ELSE t.d END AS shifted FROM r JOIN cal c ON c.d = s LEFT JOIN cal t ON t.is_trading AND t.trading_idx = c.trading_idx + n AND n > 0"""
)
def add_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.add_trading_days(_ranges(spark, sf_dir).drop("e"), a.cal(spark), "s", "n")


@query(f"WITH {a.cal_sql()}, r AS ({_RANGES}) SELECT o_orderkey, s, e, (SELECT count(*) FROM cal WHERE is_trading AND d BETWEEN s AND e) AS n_trading_days FROM r")
def count_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _ranges(spark, sf_dir).drop("n")
    return calendar.count_trading_days(ranges, calendar.calendar_for(ranges, ["s", "e"], a.holidays(spark)), "s", "e")


@query(
    f"""WITH {a.cal_sql(a.EVENT_CAL)} SELECT event_id, CASE WHEN c.is_trading AND hour(ts) < 18 THEN p.last_trading_day ELSE c.last_trading_day END AS expected_date
FROM events JOIN cal c ON c.d = ts::DATE JOIN cal p ON p.d = ts::DATE - 1"""
)
def expected_last_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.with_expected_date(a.table(spark, sf_dir, "events").select("event_id", "ts"), a.cal(spark, a.EVENT_CAL), "ts").drop("ts")


@query("SELECT event_id, ts::TIME BETWEEN TIME '09:15:00' AND TIME '15:30:00' AS in_hours, hour(ts) >= 18 AS data_out FROM events")
def market_hours_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "events").select("event_id", in_market_hours(F.col("ts")).alias("in_hours"), data_available(F.col("ts")).alias("data_out"))


_SUMMARY = f"""{a.STORED}, {a.SEGS}, summ AS (SELECT s.exchange, s.segment, coalesce(n, 0)::BIGINT AS n_files, last_date, last_date IS NULL AS is_first_run, coalesce(nf, 0) > 0 AS is_valid
FROM segs s LEFT JOIN (SELECT exchange, segment, count(*) AS n, max(file_date) AS last_date, count(*) FILTER (length > 0) AS nf FROM stored GROUP BY ALL) t USING (exchange, segment))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.segment_summary(specs.segment_table(spark), coverage.stored_files(a.files(spark, sf_dir)))


@query(f"WITH {_SUMMARY} SELECT exchange, segment, n_files, last_date FROM summ")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("exchange", "segment", "n_files", "last_date")


@query(f"WITH {_SUMMARY} SELECT exchange, segment, is_first_run, is_valid FROM summ")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("exchange", "segment", "is_first_run", "is_valid")


_COVERED = f"""{a.cal_sql()}, {_SUMMARY}, cov AS (SELECT exchange, segment, last_date, (SELECT count(*) FROM cal WHERE is_trading AND d > last_date AND d <= DATE '{a.EXPECTED}') AS n_missing,
coalesce(last_date >= DATE '{a.EXPECTED}', false) AS up_to_date FROM summ)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(_summary(spark, sf_dir), a.cal(spark), a.EXPECTED)


@query(f"WITH {_COVERED} SELECT * FROM cov")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)


@query(
    f"""WITH {_COVERED}, r AS (SELECT *, CASE WHEN last_date IS NULL THEN exchange || '_' || segment || ' (No data found)' WHEN NOT up_to_date THEN exchange || '_' || segment || ' (Missing ' || n_missing || ' days)' END AS reason FROM cov)
SELECT bool_and(up_to_date) AS all_up_to_date, coalesce(string_agg(reason, ', ' ORDER BY reason), '') AS reasons, max(last_date) AS last_date, count(DISTINCT last_date) AS n_last_dates FROM r"""
)
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.overall_status(_covered(spark, sf_dir))


@query(f"WITH {a.cal_sql()}, {_SUMMARY} SELECT exchange, segment, d AS missing_date FROM summ JOIN cal ON is_trading AND d > last_date AND d <= DATE '{a.EXPECTED}'")
def missing_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_days(_summary(spark, sf_dir), a.cal(spark), a.EXPECTED)


@query(
    f"""WITH {a.cal_sql()}, {_SUMMARY} SELECT s.exchange, s.segment, d AS missing_date FROM summ s, cal WHERE is_trading AND d BETWEEN DATE '2001-01-01' AND DATE '{a.EXPECTED}'
AND NOT EXISTS (SELECT 1 FROM stored t WHERE t.exchange = s.exchange AND t.segment = s.segment AND t.file_date = d)"""
)
def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = coverage.stored_files(a.files(spark, sf_dir))
    return coverage.gaps(_summary(spark, sf_dir), stored, a.cal(spark), date(2001, 1, 1), a.EXPECTED)


_BASE = date(2001, 7, 15)
_PLAN = f"""{a.cal_sql()}, {_SUMMARY}, rng AS (SELECT segs.*, greatest(coalesce(last_date + 1, DATE '{_BASE}'), available_from) AS start_date,
(SELECT CASE WHEN c.is_trading THEN p.last_trading_day ELSE c.d END FROM cal c, cal p WHERE c.d = DATE '{a.AS_OF.date()}' AND p.d = c.d - 1) AS end_date FROM segs JOIN summ USING (exchange, segment)),
man AS (SELECT exchange, segment, d AS target_date, base_url || '/' || replace(filename_pattern, '{{date}}', CASE fmt WHEN '%Y%m%d' THEN strftime(d, '%Y%m%d') WHEN '%d%m%y' THEN strftime(d, '%d%m%y') ELSE strftime(d, '%d%m%Y') END) AS url, strftime(d, '%Y-%m-%d') || file_suffix || '.txt' AS file_name
FROM rng JOIN cal ON d BETWEEN start_date AND end_date AND NOT is_weekend AND NOT is_holiday)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cal = a.cal(spark)
    ranges = planning.date_ranges(specs.segment_table(spark), _summary(spark, sf_dir), cal, a.AS_OF, base_start=_BASE)
    return ranges, planning.fetch_manifest(ranges, cal)


@query(f"WITH {_PLAN} SELECT * FROM man")
def fetch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


@query(f"WITH {_PLAN} SELECT exchange, segment, start_date, end_date FROM rng")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0].select("exchange", "segment", "start_date", "end_date")


@query(f"WITH {_PLAN} SELECT exchange, segment, min(target_date) AS next_from, max(target_date) AS next_to, count(target_date) AS n_pending FROM segs LEFT JOIN man USING (exchange, segment) GROUP BY ALL")
def pending_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.pending(*_plan(spark, sf_dir))


_NAMES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'BhavCopy_NSE_CM_0_0_0_' || strftime(o_orderdate, '%Y%m%d') || '_F_0000.csv.zip' WHEN 1 THEN 'sme' || strftime(o_orderdate, '%d%m%y') || '.csv' WHEN 2 THEN 'ind_close_all_' || strftime(o_orderdate, '%d%m%Y') || '.csv' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || '-NSE-EQ.txt' ELSE 'sme' || strftime(o_orderdate, '%d%m%y') || '.txt' END AS file_name FROM orders"
_IN_NAME = "try_strptime(nullif(regexp_extract(file_name, '{}', 1), ''), '{}')::DATE AS {}"


@query(
    f"WITH n AS ({_NAMES}) SELECT o_orderkey, file_name, "
    + ", ".join(
        _IN_NAME.format(*x)
        for x in (
            (r"(\d{4}-\d{2}-\d{2})", "%Y-%m-%d", "iso_date"), (r"(\d{8})", "%Y%m%d", "ymd_date"), (r"(\d{6})", "%d%m%y", "dmy_date"),
            (r"BhavCopy_NSE_CM_0_0_0_(\d{8})", "%Y%m%d", "eq_date"), (r"^sme(\d{6})\.csv$", "%d%m%y", "sme_date"),
        )
    )
    + " FROM n"
)
def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("BhavCopy_NSE_CM_0_0_0_"), F.date_format(d, "yyyyMMdd"), F.lit("_F_0000.csv.zip")))
        .when(k == 1, F.concat(F.lit("sme"), F.date_format(d, "ddMMyy"), F.lit(".csv")))
        .when(k == 2, F.concat(F.lit("ind_close_all_"), F.date_format(d, "ddMMyyyy"), F.lit(".csv")))
        .when(k == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("-NSE-EQ.txt")))
        .otherwise(F.concat(F.lit("sme"), F.date_format(d, "ddMMyy"), F.lit(".txt")))
    )
    n, eq, sme = F.col("file_name"), specs.SEGMENTS["NSE_EQ"], specs.SEGMENTS["NSE_SME"]
    return a.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("file_name")).select(
        "*", date_in_name(n, "yyyy-MM-dd").alias("iso_date"), date_in_name(n, "yyyyMMdd").alias("ymd_date"), date_in_name(n, "ddMMyy").alias("dmy_date"),
        raw_name_date(n, eq.raw_name, eq.date_format).alias("eq_date"), raw_name_date(n, sme.raw_name, sme.date_format).alias("sme_date"),
    )


_TODAY = date(2024, 1, 30)


@query(
    f"""WITH {a.cal_sql(a.EVENT_CAL)}, {a.FETCH_LOG}, {a.SEGS}, k AS (SELECT f.event_id, f.segment, f.target_date, f.error_message, timeout_absent, critical,
CASE WHEN target_date = DATE '{_TODAY}' THEN 'today' WHEN is_weekend THEN 'weekend' WHEN is_holiday THEN 'holiday' ELSE 'trading' END AS day_kind
FROM fetch_log f JOIN segs ON segs.name = f.segment LEFT JOIN cal ON d = target_date WHERE NOT success)
SELECT event_id, segment, target_date, day_kind, CASE WHEN NOT (contains(lower(coalesce(error_message, '')), 'not available') OR contains(coalesce(error_message, ''), '404') OR (timeout_absent AND contains(lower(coalesce(error_message, '')), 'timeout'))) THEN 'failed'
WHEN day_kind <> 'trading' THEN 'info' WHEN critical THEN 'critical' ELSE 'notice' END AS severity FROM k"""
)
def missing_file_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.missing_severity(a.fetch_log(spark, sf_dir), a.cal(spark, a.EVENT_CAL), specs.segment_table(spark), _TODAY)
    return found.select("event_id", "segment", "target_date", "day_kind", "severity")


_CLASS = """CASE WHEN error_message IS NULL OR error_message = '' THEN 'unknown' WHEN contains(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, 'connection|network|reset|refused') THEN 'network'
WHEN regexp_matches(m, '500|502|503|504') THEN 'server_error' WHEN regexp_matches(m, '404|not found') THEN 'file_not_found' WHEN regexp_matches(m, '403|401|forbidden|unauthorized') THEN 'access_denied'
WHEN regexp_matches(m, 'ssl|certificate|cert') THEN 'ssl_error' ELSE 'unknown' END"""


@query(
    f"""WITH {a.FETCH_LOG}, c AS (SELECT segment, {_CLASS} AS error_type FROM (SELECT *, lower(error_message) AS m FROM fetch_log WHERE NOT success))
SELECT segment, error_type, error_type IN ('timeout', 'network', 'server_error', 'ssl_error') AS should_retry, count(*) AS n_errors FROM c GROUP BY ALL"""
)
def fetch_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchlog.error_counts(a.fetch_log(spark, sf_dir))


@query(
    f"""WITH {a.FETCH_LOG}, t AS (SELECT segment, count(*) AS n_files, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_failed, coalesce(sum(file_size) FILTER (success), 0)::BIGINT AS n_bytes,
round(sum(seconds), 2) AS seconds, count(*) FILTER (attempt > 1) AS n_retries FROM fetch_log GROUP BY segment)
SELECT *, round(CASE WHEN seconds > 0 THEN n_bytes / seconds ELSE 0 END, 2) AS bytes_per_second, round(CASE WHEN seconds > 0 THEN n_ok / seconds ELSE 0 END, 4) AS files_per_second, round(100 * n_ok / n_files, 4) AS success_rate FROM t"""
)
def fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchlog.fetch_stats(a.fetch_log(spark, sf_dir))


@query(
    f"""WITH {a.FETCH_LOG}, p AS (SELECT target_date, segment, bool_or(success) AS ok FROM fetch_log GROUP BY ALL)
SELECT target_date, count(*) AS n_segments, count(*) FILTER (ok) AS n_ok, CASE WHEN count(*) FILTER (ok) = 0 THEN 'none' WHEN count(*) FILTER (ok) = count(*) THEN 'all' ELSE 'partial' END AS status FROM p GROUP BY 1"""
)
def completion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchlog.completion(a.fetch_log(spark, sf_dir))


@query(f"WITH {_NSE} SELECT exchange, source_segment, file_date, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM cons GROUP BY ALL")
def rows_per_day_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.rows_per_day(_nse(spark, sf_dir))


@query(f"WITH {_NSE} SELECT exchange, file_date, string_agg(DISTINCT source_segment, ',' ORDER BY source_segment) AS segments, count(DISTINCT source_segment) AS n_segments FROM cons GROUP BY ALL")
def segments_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.segments_per_day(_nse(spark, sf_dir))


@query(f"WITH {a.RAW_CM} SELECT TckrSymb AS symbol, file_date, OpnPric::DECIMAL(18,2)::VARCHAR AS open_text, HghPric::DECIMAL(18,2)::VARCHAR AS high_text FROM raw_cm")
def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.raw_cm(spark, sf_dir).select(F.col("TckrSymb").alias("symbol"), "file_date", money(F.col("OpnPric")).alias("open_text"), money(F.col("HghPric")).alias("high_text"))


_PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"]
_KINDS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_extendedprice": "double", "l_returnflag": "string"}
_ONE = """SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS n_rows, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_distinct, {lo} AS least, {hi} AS greatest FROM lineitem"""


@query(
    "WITH p AS ("
    + " UNION ALL ".join(
        _ONE.format(c=c, t=t, lo=f"min({c})::BIGINT" if "int" in t else "NULL::BIGINT", hi=f"max({c})::BIGINT" if "int" in t else "NULL::BIGINT") for c, t in _KINDS.items()
    )
    + """) SELECT *, n_distinct / n_rows < 0.5 AS use_dictionary, CASE WHEN least IS NULL THEN NULL WHEN least >= -128 AND greatest < 128 THEN 'tinyint'
WHEN least >= -32768 AND greatest < 32768 THEN 'smallint' WHEN least >= -2147483648 AND greatest < 2147483648 THEN 'int' ELSE 'bigint' END AS narrow_type FROM p"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(a.table(spark, sf_dir, "lineitem"), _PROFILED)


@query(
    "WITH p AS ("
    + " UNION ALL ".join(
        _ONE.format(c=c, t=t, lo=f"min({c})::BIGINT" if "int" in t else "NULL::BIGINT", hi=f"max({c})::BIGINT" if "int" in t else "NULL::BIGINT") for c, t in _KINDS.items()
    )
    + ") SELECT column_name, type, n_rows, least, greatest, n_distinct, true AS near FROM p"
)
def profile_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day, added in two runs, merge to the whole table's profile; the estimates are held against exact counts."""
    path, rows = shared_folder(spark, "sketches"), a.table(spark, sf_dir, "lineitem").withColumn("file_date", F.col("l_shipdate").cast("date"))
    profile.add_days(rows.where("file_date < '1995-01-01'"), path, _PROFILED)
    merged = profile.merged_profile(profile.add_days(rows, path, _PROFILED)).withColumnRenamed("n_distinct", "estimate")
    exact = profile.profile(rows, _PROFILED).select("column_name", "n_distinct")
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.1 * F.col("n_distinct")
    return merged.join(F.broadcast(exact), "column_name").select("column_name", "type", "n_rows", "least", "greatest", "n_distinct", near.alias("near"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem")
def narrow_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stay what they are in narrower types (cast back, as the widths depend on the data)."""
    slim = profile.narrow_integers(a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    return slim.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("bigint"), "l_extendedprice")


@query(f"WITH {a.RAW_CM} SELECT file_date, min(line_no) AS first_line, count(*) AS n_rows FROM raw_cm GROUP BY 1")
def file_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.files_with_rows(a.raw_cm(spark, sf_dir))


_LINES = "SELECT CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') || ' - Feast' WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') || ', Feast' WHEN 2 THEN strftime(o_orderdate, '%d %b %Y') WHEN 3 THEN strftime(o_orderdate, '%d %B %Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'closed' END AS line FROM orders"


@query(
    f"""WITH l AS ({_LINES}), p AS (SELECT trim(string_split(trim(string_split(line, '-')[1]), ',')[1]) AS t FROM l)
SELECT DISTINCT coalesce(try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y/%m/%d'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%d %B %Y'))::DATE AS holiday FROM p
WHERE coalesce(try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y/%m/%d'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%d %B %Y')) IS NOT NULL"""
)
def holiday_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    line = (
        F.when(k == 0, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" - Feast"))).when(k == 1, F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit(", Feast")))
        .when(k == 2, F.date_format(d, "dd MMM yyyy")).when(k == 3, F.date_format(d, "dd MMMM yyyy")).when(k == 4, F.date_format(d, "yyyy-MM-dd")).otherwise("closed")
    )
    return calendar.parse_holidays(a.table(spark, sf_dir, "orders").select(line.alias("value")))


def _day_files(df: DataFrame, columns: list[str], spec: specs.SegmentSpec) -> DataFrame:
    """Rows as one text per day, zipped if the segment's are -> file_name, content."""
    import io
    import zipfile

    import pyarrow as pa

    def pack(day: pa.Table) -> pa.Table:
        name, out = day["file_name"][0].as_py(), io.BytesIO()
        lines = day.sort_by("line_no")["line"].to_pylist()
        text = "\n".join([",".join(columns), *lines, ""])
        if not spec.zipped:
            return pa.table({"file_name": [name], "content": [text.encode()]})
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("about.txt", "x")
            z.writestr(name.removesuffix(".zip"), text)
        return pa.table({"file_name": [name], "content": [out.getvalue()]})

    return _plain_lines(df, columns, spec).groupBy("file_name").applyInArrow(pack, "file_name string, content binary")


@query(
    f"""WITH {a.RAW_CM} SELECT TradDt, TckrSymb, SctySrs, OpnPric, HghPric, LwPric, ClsPric, TtlTradgVol, file_date, row_number() OVER (PARTITION BY file_date ORDER BY line_no) AS line_no FROM raw_cm"""
)
def zip_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's rows as a zipped file, read again."""
    spec = specs.SEGMENTS["NSE_EQ"]
    columns = ["TradDt", "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol"]
    return readers.good(readers.parse_files(_day_files(a.raw_cm(spark, sf_dir), columns, spec), spec))


@query(f"WITH {a.RAW_SME} SELECT SYMBOL, p AS OPEN_PRICE, p AS CLOSE_PRICE, NET_TRDQTY, file_date, row_number() OVER (PARTITION BY file_date ORDER BY line_no) AS line_no FROM raw_sme")
def csv_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's rows as a plain file, read again by splits, without Python."""
    spec, columns, path = specs.SEGMENTS["NSE_SME"], ["SYMBOL", "OPEN_PRICE", "CLOSE_PRICE", "NET_TRDQTY"], shared_folder(spark, "plain")
    named.write_named(_plain_lines(a.raw_sme(spark, sf_dir), columns, spec), path, ["line_no"], header=",".join(columns))
    return readers.read_plain(spark, path, spec).select(*columns, "file_date", "line_no")


def _plain_lines(df: DataFrame, columns: list[str], spec: specs.SegmentSpec) -> DataFrame:
    file_name = F.replace(F.lit(spec.filename_pattern), F.lit("{date}"), F.date_format("file_date", spec.date_format))
    return df.select(file_name.alias("file_name"), sinks.csv_line(columns).alias("line"), "line_no")


@query(f"WITH {a.RAW_SME} SELECT SYMBOL, p AS OPEN_PRICE, NET_TRDQTY, file_date, row_number() OVER (PARTITION BY file_date ORDER BY line_no) AS line_no FROM raw_sme")
def segment_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment out of a folder of two: files of the other one aren't opened."""
    path = shared_folder(spark, "segments")
    for segment, df in (("NSE_SME", a.raw_sme(spark, sf_dir)), ("NSE_INDEX", a.raw_idx(spark, sf_dir))):
        columns = [c for c in df.columns if c not in ("file_date", "line_no")]
        named.write_named(_plain_lines(df, columns, specs.SEGMENTS[segment]), path, ["line_no"], header=",".join(columns))
    rows = segments.read_segments(spark, path, ["NSE_SME", "NSE_INDEX"]).where("segment_name = 'NSE_SME'")
    return readers.good(rows).select("SYMBOL", "OPEN_PRICE", "NET_TRDQTY", "file_date", "line_no")


@query(f"WITH {a.RAW_CM} SELECT file_date, TckrSymb AS symbol, line_no, row_number() OVER (PARTITION BY file_date ORDER BY TckrSymb NULLS LAST, line_no) AS place FROM raw_cm WHERE SctySrs IN ('EQ', 'BE', 'BZ')")
def symbols_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a day's rows as they come."""
    rows = normalize.by_symbol(normalize.nse_eq(a.raw_cm(spark, sf_dir))).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file_date").orderBy("at"))
    return rows.select("file_date", F.col("TckrSymb").alias("symbol"), "line_no", place.alias("place"))


@query(f"WITH {_SUMMARY} SELECT exchange, segment, n_files, last_date FROM summ WHERE exchange || '_' || segment IN ('NSE_EQ', 'BSE_INDEX')")
def chosen_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some segments only; an unknown name is ignored."""
    chosen = specs.segment_table(spark, ["NSE_EQ", "BSE_INDEX", "LSE_EQ"])
    return coverage.segment_summary(chosen, coverage.stored_files(a.files(spark, sf_dir))).select("exchange", "segment", "n_files", "last_date")


_ORDERED = f"""WITH {_NSE} SELECT symbol, trade_date, open, close, volume, exchange, segment, file_date, source_segment,
row_number() OVER (PARTITION BY file_date ORDER BY source_rank, CASE WHEN source_rank = 0 THEN symbol END NULLS LAST, line_no) AS row_order FROM cons"""
_LAKE = ["symbol", "trade_date", "open", "close", "volume", "exchange", "segment", "file_date", "source_segment", "row_order"]


@query(_ORDERED)
def lake_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice, read back."""
    lake, rows = shared_folder(spark, "lake"), _nse(spark, sf_dir)
    for _ in range(2):
        sinks.write_ordered(rows, lake)
    return spark.read.parquet(lake).select(*_LAKE)


@query(_ORDERED)
def stream_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments arrive as files in any order and are consolidated as they come: each segment is one delivery of many files, dealt by month, so that a month
    isn't computed anew in every batch."""
    base = shared_folder(spark, "stream")
    eq, sme, idx = normalize.nse_eq(a.raw_cm(spark, sf_dir)), normalize.sme(a.raw_sme(spark, sf_dir), suffix=True), normalize.nse_index(a.raw_idx(spark, sf_dir))
    for name, df in (("INDEX", idx), ("EQ", eq), ("SME", sme)):
        rows = append.unified(df).withColumns({"source_segment": F.lit(name), "delivery": F.lit(0).cast("bigint")})
        rows.repartition(sinks.month_of(F.col("file_date"))).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(f"{arrivals.SCHEMA}, delivery bigint").option("maxFilesPerTrigger", 8).parquet(f"{base}/in")
    arrivals.stream_consolidate(arriving, "NSE", f"{base}/landed", f"{base}/lake", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/lake").select(*_LAKE)


@query(f"WITH {_NSE} SELECT strftime(file_date, '%Y-%m-%d') || '-NSE-EQ.txt' AS file_name, count(*) AS n_lines, sum(volume)::BIGINT AS volume FROM cons GROUP BY 1")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one headerless text per day: the last field is the volume."""
    lines = sinks.day_lines(append.ordered(_nse(spark, sf_dir)), specs.SEGMENTS["NSE_EQ"].file_suffix)
    return lines.groupBy("file_name").agg(F.count("*").alias("n_lines"), F.sum(F.element_at(F.split("line", ","), -1).cast("bigint")).alias("volume"))


def _written_days(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "days")
    sinks.write_days(append.ordered(_nse(spark, sf_dir)), path, specs.SEGMENTS["NSE_EQ"].file_suffix)
    return path


@query(f"WITH {_NSE} SELECT DISTINCT strftime(file_date, '%Y-%m-%d') || '-NSE-EQ.txt' AS file_name, true AS has_bytes FROM cons")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' files as they are listed."""
    return readers.inventory(spark, _written_days(spark, sf_dir)).select("file_name", (F.col("length") > 0).alias("has_bytes"))


@query(f"WITH {_NSE} SELECT symbol, trade_date, open, close, volume, file_date FROM cons")
def days_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' files, headerless, by their names."""
    return readers.read_normalized(spark, _written_days(spark, sf_dir)).select("symbol", "trade_date", "open", "close", "volume", "file_date")


@query(f"WITH {_NSE} SELECT exchange || '_' || segment || '_' || strftime(file_date, '%d%m%Y') || '_combined.csv' AS file_name, count(*) AS n_rows, sum(volume)::BIGINT AS volume FROM cons GROUP BY 1")
def combined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text with a header per day and all its segments."""
    path = shared_folder(spark, "combined")
    sinks.write_combined(append.ordered(_nse(spark, sf_dir)).select(*specs.UNIFIED, "exchange", "segment", "file_date", "row_order"), path)
    rows = spark.read.schema(specs.UNIFIED_SCHEMA).csv(path, header=True)
    return rows.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n_rows"), F.sum("volume").cast("bigint").alias("volume"))


@query("SELECT l_orderkey, l_partkey, l_quantity * 2 AS doubled FROM lineitem WHERE l_returnflag = 'A'")
def csv_transform_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A big CSV through a caller's function."""
    base = shared_folder(spark, "csv")
    a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").write.csv(f"{base}/in", header=True)
    fn = lambda df: df.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 2).alias("doubled"))
    readers.transform_csv(spark, f"{base}/in", "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string", fn, f"{base}/out")
    return spark.read.schema("l_orderkey bigint, l_partkey bigint, doubled double").csv(f"{base}/out", header=True)


_BY_MONTH = "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_custkey, (row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1) // 40 AS chunk FROM orders"


@query(
    f"""WITH o AS ({_BY_MONTH}), c AS (SELECT month, chunk, count(*) AS n_rows, bool_or(o_custkey % 97 = 0) AS bad FROM o GROUP BY ALL)
SELECT month, o_orderkey, o_custkey * 2 AS doubled, NULL::BIGINT AS chunk, NULL::BIGINT AS first_row, NULL::BIGINT AS n_rows, NULL::VARCHAR AS reason FROM o JOIN c USING (month, chunk) WHERE NOT bad
UNION ALL SELECT month, NULL, NULL, chunk, chunk * 40, n_rows, 'ValueError: odd customer' FROM c WHERE bad"""
)
def csv_chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big CSVs through a caller's pandas function that fails on some chunks: all others are written, the failed ones listed.  Chunks are counted in a file's
    blocks; a month of orders is one block."""
    base = shared_folder(spark, "chunks")
    rows = a.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_custkey")
    lines = rows.select(F.concat(F.lit("orders-"), "month", F.lit(".csv")).alias("file_name"), sinks.csv_line(["month", "o_orderkey", "o_custkey"]).alias("line"), "o_orderkey")
    named.write_named(lines, f"{base}/in", ["o_orderkey"], header="month,o_orderkey,o_custkey")

    def double(chunk):
        if (chunk["o_custkey"] % 97 == 0).any():
            raise ValueError("odd customer")
        return chunk.assign(doubled=chunk["o_custkey"] * 2)

    out = "month string, o_orderkey bigint, doubled bigint"
    _, faults = readers.transform_chunks(spark, f"{base}/in", "month string, o_orderkey bigint, o_custkey bigint", double, out, f"{base}/out", chunk_rows=40)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    done = spark.read.schema(out).csv(f"{base}/out", header=True).select("*", none("chunk", "bigint"), none("first_row", "bigint"), none("n_rows", "bigint"), none("reason", "string"))
    month = F.regexp_extract("file_name", r"orders-(.*)\.csv", 1).alias("month")
    return done.unionByName(faults.select(month, none("o_orderkey", "bigint"), none("doubled", "bigint"), "chunk", "first_row", "n_rows", "reason"))


@query(
    f"""WITH {_NSE}, o AS (SELECT *, row_number() OVER (PARTITION BY file_date ORDER BY source_rank, CASE WHEN source_rank = 0 THEN symbol END NULLS LAST, line_no) AS row_order FROM cons WHERE day(file_date) <> 13)
SELECT file_date, source_segment, symbol, open, volume, row_order, NULL::VARCHAR AS reason FROM o
UNION ALL SELECT file_date, 'EQ', 'BhavCopy_NSE_CM_0_0_0_' || strftime(file_date, '%Y%m%d') || '_F_0000.csv.zip', NULL, NULL, NULL, 'unreadable: BadZipFile'
FROM (SELECT DISTINCT file_date FROM raw_cm WHERE day(file_date) = 13)"""
)
def stream_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped equities and plain other segments land as raw files in any order, the archives of some days damaged: the lake and the quarantine."""
    base, eq, sme, idx = shared_folder(spark, "archives"), specs.SEGMENTS["NSE_EQ"], specs.SEGMENTS["NSE_SME"], specs.SEGMENTS["NSE_INDEX"]
    columns = ["TradDt", "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol"]
    archives = _day_files(a.raw_cm(spark, sf_dir), columns, eq)
    thirteenth = F.dayofmonth(F.to_date(F.regexp_extract("file_name", eq.raw_name, 1), "yyyyMMdd")) == 13
    archives = archives.withColumn("content", F.when(thirteenth, F.substring("content", 1, 90)).otherwise(F.col("content")))
    index = a.raw_idx(spark, sf_dir)
    for folder, files in (
        ("index", _day_files(index, [c for c in index.columns if c not in ("file_date", "line_no")], idx)),
        ("eq", archives),
        ("sme", _day_files(a.raw_sme(spark, sf_dir), ["MARKET", "SERIES", "SYMBOL", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "NET_TRDQTY"], sme)),
    ):
        named.write_contents(files, f"{base}/raw/{folder}")
    arrivals.stream_archives(spark, f"{base}/raw", "NSE", f"{base}/landed", f"{base}/lake", f"{base}/bad", f"{base}/state").awaitTermination()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    lake = spark.read.parquet(f"{base}/lake").select("file_date", "source_segment", "symbol", "open", "volume", "row_order", none("reason", "string"))
    bad = arrivals.quarantined(spark, f"{base}/bad", f"{base}/raw")
    return lake.unionByName(bad.select("file_date", F.lit("EQ").alias("source_segment"), F.col("file_name").alias("symbol"), none("open", "double"), none("volume", "double"), none("row_order", "bigint"), "reason"))


@query(f"WITH {_NSE} SELECT exchange, segment, file_date, source_segment, symbol, open, volume FROM cons")
def append_with_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped before its markers, a run over half of the segments, and two over all: each day and segment is there once."""
    rows, lake = _nse(spark, sf_dir).select("exchange", "segment", "file_date", "source_segment", "symbol", "open", "volume"), shared_folder(spark, "once")
    commits.write_rows(rows.where("source_segment <> 'INDEX'"), lake, "0-stopped")
    commits.append_once(rows.where("source_segment <> 'SME'"), lake)
    for _ in range(2):
        commits.append_once(rows, lake)
    return commits.committed(spark, lake, "exchange string, segment string, file_date date, source_segment string, symbol string, open double, volume double")


@query(
    f"""WITH {_NSE}, p AS (SELECT file_date, 'EQ' AS s, count(*) AS n FROM eq GROUP BY 1 UNION ALL SELECT file_date, 'SME', count(*) FROM raw_sme GROUP BY 1 UNION ALL SELECT file_date, 'INDEX', count(*) FROM raw_idx GROUP BY 1)
SELECT 'NSE' AS exchange, file_date, CASE WHEN count(*) = 3 THEN 'complete' ELSE 'pending' END AS status, string_agg(s, ',' ORDER BY s) AS segments, sum(n)::BIGINT AS n_rows FROM p GROUP BY file_date"""
)
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days wait, with state, until all their segments have come."""
    base = shared_folder(spark, "days")
    segments = {"INDEX": normalize.nse_index(a.raw_idx(spark, sf_dir)), "EQ": normalize.nse_eq(a.raw_cm(spark, sf_dir)), "SME": normalize.sme(a.raw_sme(spark, sf_dir))}
    for i, (name, df) in enumerate(segments.items()):
        came = df.groupBy("file_date").agg(F.count("*").alias("n_rows")).select(F.lit("NSE").alias("exchange"), "file_date", F.lit(name).alias("source_segment"), "n_rows", F.lit(f"2001-01-01 0{i}:00:00").cast("timestamp").alias("arrived"))
        came.coalesce(1).write.mode("append").parquet(f"{base}/in")  # one row per day
    arriving = spark.readStream.schema(came.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    waiting.stream_days(spark, arriving, f"{base}/out", f"{base}/state").awaitTermination()
    return waiting.last_statuses(spark, f"{base}/out")


#: Date columns by query; results give them as text, so that engines need not agree on a date's form.
DATES = {
    "file_date": "normalize_nse_eq normalize_bse_eq normalize_bse_eq_denied_table normalize_sme normalize_sme_suffix normalize_nse_index normalize_bse_index fut_roman_symbols fut_quarantine consolidate_nse consolidate_nse_without_sme zip_ingest_roundtrip lake_write_roundtrip stream_consolidate consolidate_bse append_order append_idempotent align_by_name align_by_position date_parse_quality index_date_quality rows_per_day_segment segments_per_day money_text file_validity csv_ingest_roundtrip symbols_in_order days_read_back segment_files_read stream_archives append_with_markers stream_days",
    "s e d": "trading_days_expand",
    "month": "month_trading_days",
    "day last_trading_day next_trading_day": "last_next_trading_day",
    "s shifted": "add_trading_days",
    "s e": "count_trading_days",
    "expected_date": "expected_last_date",
    "last_date": "segment_summary chosen_segments coverage_status overall_status",
    "missing_date": "missing_trading_days gap_days",
    "target_date": "fetch_manifest missing_file_severity completion_status",
    "start_date end_date": "date_ranges",
    "next_from next_to": "pending_days",
    "iso_date ymd_date dmy_date eq_date sme_date": "filename_dates",
    "holiday": "holiday_parse",
}


def _dates_as_text(fn: Query, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in columns})

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


for _columns, _names in DATES.items():
    for _name in _names.split():
        QUERIES[_name] = _dates_as_text(QUERIES[_name], _columns.split())
        SQL[_name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in _columns.split())}) FROM ({SQL[_name]})"
