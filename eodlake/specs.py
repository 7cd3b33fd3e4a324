"""Segments as data (S6, X1): where files come from, how they look and what is kept of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the exchanges' file formats.
EQ_DROPPED = [
    "BizDt", "Sgmt", "Src", "FinInstrmTp", "FinInstrmId", "ISIN", "XpryDt", "FininstrmActlXpryDt", "StrkPric", "OptnTp",
    "FinInstrmNm", "LastPric", "PrvsClsgPric", "UndrlygPric", "SttlmPric", "OpnIntrst", "ChngInOpnIntrst", "TtlTrfVal",
    "TtlNbOfTxsExctd", "SsnId", "NewBrdLotQty", "Rmks", "Rsvd1", "Rsvd2", "Rsvd3", "Rsvd4",
]
FO_DROPPED = [c for c in EQ_DROPPED if c != "XpryDt"] + ["SctySrs"]
SME_DROPPED = ["MARKET", "SERIES", "SECURITY", "PREV_CL_PR", "NET_TRDVAL", "CORP_IND", "HI_52_WK", "LO_52_WK"]
NSE_INDEX_DROPPED = ["Points Change", "Change(%)", "Turnover (Rs. Cr.)", "P/E", "P/B", "Div Yield"]
BSE_INDEX_KEPT = ["IndexName", "OpenPrice", "HighPrice", "LowPrice", "ClosePrice"]
BSE_INDEX_ORDER = ["IndexName", "Date", "OpenPrice", "HighPrice", "LowPrice", "ClosePrice", "Volume"]
NSE_SERIES = ["EQ", "BE", "BZ"]
BSE_GROUPS = ["A", "B", "M", "MS", "MT", "P", "R", "T", "W", "X", "XT", "Z", "ZP"]
FUTURES = ["STF", "IDF"]
SENTINEL = "BSE SENSEX"
BASE_START = date(2025, 7, 15)

EQ_SCHEMA = "TradDt string, TckrSymb string, SctySrs string, OpnPric double, HghPric double, LwPric double, ClsPric double, TtlTradgVol bigint"
FO_SCHEMA = "TradDt string, FinInstrmTp string, FinInstrmId string, TckrSymb string, XpryDt string, OpnPric double, HghPric double, LwPric double, ClsPric double, TtlTradgVol bigint"
SME_SCHEMA = "SYMBOL string, OPEN_PRICE double, HIGH_PRICE double, LOW_PRICE double, CLOSE_PRICE double, NET_TRDQTY bigint"
NSE_INDEX_SCHEMA = "`Index Name` string, `Index Date` string, `Open Index Value` double, `High Index Value` double, `Low Index Value` double, `Closing Index Value` double, `Volume` bigint"
BSE_INDEX_SCHEMA = "IndexName string, OpenPrice double, HighPrice double, LowPrice double, ClosePrice double"

#: The unified layout that normalised segments are appended in.
UNIFIED = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
UNIFIED_SCHEMA = "symbol string, trade_date string, open double, high double, low double, close double, volume double"


@dataclass(frozen=True)
class SegmentSpec:
    exchange: str
    segment: str
    base_url: str
    filename_pattern: str
    date_format: str
    file_suffix: str
    schema: str
    raw_name: str  # matches the file's name, the date text as its group
    zipped: bool = False
    available_from: date | None = None
    timeout_means_absent: bool = False
    critical: bool = False

    @property
    def name(self) -> str:
        return f"{self.exchange}_{self.segment}"


SEGMENTS = {
    s.name: s
    for s in (
        SegmentSpec("NSE", "EQ", "https://archives.nseindia.com/content/cm", "BhavCopy_NSE_CM_0_0_0_{date}_F_0000.csv.zip", "yyyyMMdd", "-NSE-EQ", EQ_SCHEMA, r"BhavCopy_NSE_CM_0_0_0_(\d{8})", True, None, True, True),
        SegmentSpec("NSE", "FO", "https://archives.nseindia.com/content/fo", "BhavCopy_NSE_FO_0_0_0_{date}_F_0000.csv.zip", "yyyyMMdd", "-NSE-FO", FO_SCHEMA, r"BhavCopy_NSE_FO_0_0_0_(\d{8})", True, None, True),
        SegmentSpec("NSE", "SME", "https://archives.nseindia.com/archives/sme/bhavcopy", "sme{date}.csv", "ddMMyy", "-NSE-SME", SME_SCHEMA, r"^sme(\d{6})\.csv$", False, None, True),
        SegmentSpec("NSE", "INDEX", "https://archives.nseindia.com/content/indices", "ind_close_all_{date}.csv", "ddMMyyyy", "-NSE-INDEX", NSE_INDEX_SCHEMA, r"ind_close_all_(\d{8})"),
        SegmentSpec("BSE", "EQ", "https://www.bseindia.com/download/BhavCopy/Equity", "BhavCopy_BSE_CM_0_0_0_{date}_F_0000.CSV", "yyyyMMdd", "-BSE-EQ", EQ_SCHEMA, r"BhavCopy_BSE_CM_0_0_0_(\d{8})"),
        SegmentSpec("BSE", "INDEX", "https://www.bseindia.com/bsedata/Index_Bhavcopy", "INDEXSummary_{date}.csv", "ddMMyyyy", "-BSE-INDEX", BSE_INDEX_SCHEMA, r"INDEXSummary_(\d{8})", False, date(2025, 4, 17)),
    )
}

#: A segment's transform, `df.transform(fn)`.
Transform = Callable[[DataFrame], DataFrame]


def segment_table(spark: SparkSession, segments: list[str] | None = None) -> DataFrame:
    """The segments' settings as rows; unknown names are ignored."""
    rows = [
        (s.exchange, s.segment, s.name, s.base_url, s.filename_pattern, s.date_format, s.file_suffix, s.available_from, s.timeout_means_absent, s.critical)
        for s in SEGMENTS.values()
        if segments is None or s.name in segments
    ]
    schema = "exchange string, segment string, name string, base_url string, filename_pattern string, date_format string, file_suffix string, available_from date, timeout_means_absent boolean, critical boolean"
    return spark.createDataFrame(rows, schema)
