"""Operators on tiny frames: edge rows of each area."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.functions import dates, text
from eodlake.operators import append, calendar, contracts, coverage, fetchlog, normalize, planning, profile

D1, D2 = date(2025, 7, 14), date(2025, 7, 15)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EQ = "TradDt string, TckrSymb string, SctySrs string, OpnPric double, HghPric double, LwPric double, ClsPric double, TtlTradgVol long, ISIN string, file_date date, line_no long"


def eq_row(symbol, series="EQ", day="2025-07-14", file_date=D1, line=1):
    return (day, symbol, series, 1.0, 2.0, 0.5, 1.5, 10, "x", file_date, line)


def test_nse_equity_edges(spark):
    df = normalize.nse_eq(frame(spark, [eq_row("B"), eq_row("NA", line=2), eq_row(None, "BE", line=3), eq_row("C", "SM"), eq_row("D", None), eq_row("E", day="bad", line=4), eq_row("F", "BZ", day=None, line=5)], EQ))
    assert df.columns == ["TckrSymb", "TradDt", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol", "file_date", "line_no"]
    got = {(r["TckrSymb"], r["TradDt"]) for r in df.collect()}
    assert got == {("B", "20250714"), ("NA", "20250714"), (None, "20250714"), ("E", None), ("F", None)}


def test_absent_columns_are_tolerated(spark):
    df = normalize.nse_eq(frame(spark, [("A", 1.0, D1, 1)], "TckrSymb string, OpnPric double, file_date date, line_no long"))
    assert df.columns == ["TckrSymb", "OpnPric", "file_date", "line_no"] and df.count() == 1


def test_denied_symbols_keep_nulls(spark):
    rows = frame(spark, [eq_row("X", "A"), eq_row("Y", "ZP"), eq_row(None, "B"), eq_row("Z", "G")], EQ)
    table = frame(spark, [("X",), ("X",), (None,)], "symbol string")
    for denied in (["X"], table):
        assert {r["TckrSymb"] for r in normalize.bse_eq(rows, denied).collect()} == {"Y", None}
    assert normalize.bse_eq(rows, []).count() == normalize.bse_eq(rows, None).count() == 3


def test_day_order_puts_nulls_last(spark):
    rows = [eq_row(s, line=i) for i, s in enumerate(["b", None, "a", "b"])]
    got = [(r["TckrSymb"], r["line_no"]) for r in normalize.by_symbol(normalize.nse_eq(frame(spark, rows, EQ))).collect()]
    assert got == [("a", 2), ("b", 0), ("b", 3), (None, 1)]


def test_sme_suffix_and_index_dates(spark):
    sme = frame(spark, [("N", "A", 1.0, 1.0, 1.0, 1.0, 5, D1, 1), ("N", None, 1.0, 1.0, 1.0, 1.0, 5, D1, 2)], "MARKET string, SYMBOL string, OPEN_PRICE double, HIGH_PRICE double, LOW_PRICE double, CLOSE_PRICE double, NET_TRDQTY long, file_date date, line_no long")
    assert [r["SYMBOL"] for r in normalize.sme(sme, True).orderBy("line_no").collect()] == ["A_SME", None]
    assert [r["SYMBOL"] for r in normalize.sme(sme).orderBy("line_no").collect()] == ["A", None]
    for extra in ("", ", `Index Date` string"):
        row = ("NIFTY", 1.0, D2, 1) + (("junk",) if extra else ())
        out = normalize.nse_index(frame(spark, [row], f"`Index Name` string, `Open Index Value` double, file_date date, line_no long{extra}"))
        assert out.columns[:2] == ["Index Name", "Index Date"] and out.first()["Index Date"] == "20250715"


def test_bse_index_missing_columns(spark):
    out = normalize.bse_index(frame(spark, [("S", 1.0, D1, 1)], "IndexName string, ClosePrice double, file_date date, line_no long"))
    assert out.columns == ["IndexName", "Date", "ClosePrice", "Volume", "file_date", "line_no"] and out.first()["Volume"] == 0
    assert normalize.bse_index(frame(spark, [("S", D1, 1)], "other string, file_date date, line_no long")).count() == 0


def test_roman_numerals_round_trip(spark):
    got = {r["n"]: r["r"] for r in spark.range(4000).select(F.col("id").alias("n"), text.roman(F.col("id")).alias("r")).collect()}
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

    def back(s):
        v = [value[c] for c in s]
        return sum(-x if i + 1 < len(v) and x < v[i + 1] else x for i, x in enumerate(v))

    assert got[0] == "" and all(back(r) == n for n, r in got.items()) and got[3999] == "MMMCMXCIX" and len(set(got.values())) == 4000


FO = "FinInstrmTp string, FinInstrmId string, TckrSymb string, XpryDt string, TradDt string, OpnPric double, file_date date"


def test_contract_numbers(spark):
    rows = [("STF", str(i), "A", f"2025-{12 - i:02d}-01", "2025-07-14", 1.0, D1) for i in range(11)]
    rows += [("STF", "x", "A", None, "2025-07-14", 1.0, D1), ("STO", "o", "A", "2025-01-01", "2025-07-14", 1.0, D1), ("IDF", "b", "B", "nope", "2025-07-14", 1.0, D1), ("IDF", "n", None, "2025-01-01", "2025-07-14", 1.0, D1), ("IDF", "2", "B", "2025-01-01", "2025-07-14", 1.0, D1), ("IDF", "1", "B", "2025-01-01", "2025-07-14", 1.0, D1), ("STF", "z", "A", "2025-09-01", "2025-07-15", 1.0, D2)]
    df = frame(spark, rows, FO)
    got = sorted((r["file_date"], r["FinInstrmId"], r["contract_no"]) for r in contracts.number_contracts(df).where("TckrSymb = 'A' and file_date = '2025-07-14'").collect())
    assert {i: n for _, i, n in got} == {str(i): 11 - i for i in range(11)} | {"x": 12}
    named = contracts.nse_fo(df)
    assert named.columns == ["SYMBOL_NEW", "TradDt", "OpnPric", "file_date"]
    names = sorted(r["SYMBOL_NEW"] for r in named.collect())
    assert names.count("A-I") == 2 and "A-XII" in names and names[-2:] == ["B-I", "B-II"]
    assert sorted(r["reason"] for r in contracts.quarantine(df).collect()) == ["bad expiry", "no ticker"]


def uni(spark, rows):
    return frame(spark, [(s, "20250714", 1.0, 1.0, 1.0, 1.0, 1, d, n) for s, d, n in rows], "symbol string, trade_date string, open double, high double, low double, close double, volume long, file_date date, line_no long")


def test_consolidation_needs_equity_and_is_in_order(spark):
    out = append.consolidate("NSE", uni(spark, [("b", D1, 1), ("a", D1, 2), (None, D1, 3)]), {"SME": uni(spark, [("z", D1, 1), ("q", D2, 1)]), "INDEX": uni(spark, [("i", D1, 2), ("h", D1, 9)])})
    got = [r["symbol"] for r in append.ordered(out).orderBy("file_date", "row_order").collect()]
    assert got == ["a", "b", None, "z", "i", "h"]
    assert append.consolidate("NSE", uni(spark, [("b", D1, 1)]), {"SME": uni(spark, [("z", D1, 1)])}, set()).count() == 1


def test_alignment(spark):
    base = frame(spark, [("a", 1.0, 2)], "n string, p double, v long")
    same = frame(spark, [("b", 3, 4.0)], "x string, y int, z double")
    assert append.align(same, base).first() == ("b", 3.0, 4)
    swapped = frame(spark, [(1.0, "b", 2)], "p double, n string, v long")
    assert append.align(frame(spark, [("1", "2.0", 2)], "p string, n string, v long"), base).columns == ["n", "p", "v"]
    assert append.align(swapped, base, strict_names=True).first() == ("b", 1.0, 2)
    narrow = append.align(frame(spark, [("b", "o"), ("", "o"), (None, "o")], "n string, other string"), base)
    assert narrow.collect() == [("b", None, None)]
    assert append.align(frame(spark, [(1,)], "other int"), base) is None
    assert append.align(base, base) is base


def test_sentinel_blocks_its_day_only(spark):
    new = uni(spark, [("S1", D1, 1), ("S2", D2, 1)])
    assert [r["symbol"] for r in append.not_yet_appended(new, uni(spark, [("BSE SENSEX 50", D1, 1), ("x", D2, 1)])).collect()] == ["S2"]


@pytest.mark.parametrize("seed", [1, 2])
def test_calendar_against_loops(spark, seed):
    r = random.Random(seed)
    start, end = date(2024, 1, 1), date(2024, 6, 30)
    free = {start + timedelta(days=r.randrange(180)) for _ in range(20)}
    cal = calendar.calendar(spark, start, end, frame(spark, [(d,) for d in free] + [(None,)], "holiday date"))
    trades = lambda d: d.weekday() < 5 and d not in free

    def back(d):
        while not trades(d):
            d -= timedelta(days=1)
        return d

    def on(d, n):
        while n > 0:
            d += timedelta(days=1)
            n -= trades(d)
        return d

    rows = [(start + timedelta(days=r.randrange(150)), r.randrange(-2, 12), start + timedelta(days=r.randrange(150))) for _ in range(80)]
    df = frame(spark, rows, "s date, n int, e date")
    got = calendar.with_next_trading_day(calendar.with_last_trading_day(df, cal, "s"), cal, "s")
    assert all(x["last_trading_day"] == back(x["s"]) and x["next_trading_day"] == on(x["s"], 1) for x in got.collect())
    assert all(x["shifted"] == (on(x["s"], x["n"]) if x["n"] > 0 else x["s"]) for x in calendar.add_trading_days(df, cal, "s", "n").collect())
    count = lambda a, b: sum(trades(a + timedelta(days=i)) for i in range((b - a).days + 1))
    assert all(x["n_trading_days"] == max(count(x["s"], x["e"]), 0) for x in calendar.count_trading_days(df, cal, "s", "e").collect())
    month = [x["d"] for x in calendar.month_trading_days(cal, 2024, 2).orderBy("d").collect()]
    assert month == [d for d in (date(2024, 2, 1) + timedelta(days=i) for i in range(29)) if trades(d)]
    stamps = [datetime(2024, 3, 1, 17, 59, 59) + timedelta(days=i, seconds=i % 2) for i in range(30)]
    for x in calendar.with_expected_date(frame(spark, [(t,) for t in stamps], "ts timestamp"), cal, "ts").collect():
        d = x["ts"].date()
        assert x["expected_date"] == (d if trades(d) and x["ts"].hour >= 18 else back(d - timedelta(days=1)) if trades(d) else back(d))


def test_dates_outside_the_calendar_fail(spark):
    cal = calendar.calendar(spark, D1, D2, frame(spark, [], "holiday date"))
    with pytest.raises(Exception, match="outside the calendar"):
        calendar.with_last_trading_day(frame(spark, [(date(1990, 1, 1),)], "s date"), cal, "s").collect()


def test_reversed_ranges_are_empty(spark):
    assert calendar.explode_range(frame(spark, [(D2, D1)], "s date, e date"), F.col("s"), F.col("e")).count() == 0
    assert calendar.days(spark, D2, D1).count() == 0


def test_flags_of_the_calendar(spark):
    holiday = frame(spark, [(D1,)], "holiday date")
    open_ = calendar.calendar(spark, D1, D1, holiday, skip_weekends=False, skip_holidays=False, pad=0)
    assert open_.first()["is_trading"]


def test_market_hours(spark):
    times = ["09:14:59", "09:15:00", "15:30:00", "15:30:00.5", "15:30:01", "17:59:59", "18:00:00"]
    df = frame(spark, [(t,) for t in times], "t string").select("t", F.to_timestamp(F.concat(F.lit("2025-07-14 "), "t")).alias("ts"))
    got = {r["t"]: (r["a"], r["b"]) for r in df.select("t", dates.in_market_hours(F.col("ts")).alias("a"), dates.data_available(F.col("ts")).alias("b")).collect()}
    assert [t for t in times if got[t][0]] == ["09:15:00", "15:30:00"] and [t for t in times if got[t][1]] == ["18:00:00"]


def test_holiday_lines(spark):
    lines = ["26/01/2025 - Republic Day", "2025/03/14, Holi", "1 May 2025", "15 August 2025", "2025-10-02", "nothing", "", "26/01/2025", " 25/12/2025 "]
    df = frame(spark, [(x,) for x in lines], "value string")
    got = {r["holiday"] for r in calendar.parse_holidays(df).collect()}
    assert got == {date(2025, 1, 26), date(2025, 3, 14), date(2025, 5, 1), date(2025, 8, 15), date(2025, 12, 25)}
    assert calendar.parse_holidays(df).count() == 5
    assert {r["value"] for r in calendar.bad_holiday_lines(df).collect()} == {"2025-10-02", "nothing"}
    assert date(2025, 10, 2) in {r["holiday"] for r in calendar.parse_holidays(df, iso=True).collect()}


def test_planning(spark):
    segments = specs.segment_table(spark)
    assert specs.segment_table(spark, ["NSE_EQ", "nonsense"]).count() == 1
    last = frame(spark, [("NSE", "EQ", date(2025, 7, 10)), ("NSE", "FO", date(2025, 8, 1))], "exchange string, segment string, last_date date")
    cal = calendar.calendar(spark, date(2025, 4, 1), date(2025, 7, 31), frame(spark, [(date(2025, 7, 11),)], "holiday date"))
    as_of = datetime(2025, 7, 15, 17, 0)
    ranges = planning.date_ranges(segments, last, cal, as_of)
    got = {(r["exchange"], r["segment"]): (r["start_date"], r["end_date"]) for r in ranges.collect()}
    assert got["NSE", "EQ"] == (date(2025, 7, 11), D1) and got["BSE", "EQ"] == (specs.BASE_START, D1)
    manifest = planning.fetch_manifest(ranges, cal)
    assert [(r["url"], r["file_name"]) for r in manifest.collect()] == [("https://archives.nseindia.com/content/cm/BhavCopy_NSE_CM_0_0_0_20250714_F_0000.csv.zip", "2025-07-14-NSE-EQ.txt")]
    assert {(r["exchange"], r["segment"]): r["n_pending"] for r in planning.pending(ranges, manifest).collect()}["NSE", "FO"] == 0
    late = planning.date_ranges(segments, last, cal, datetime(2025, 7, 15, 18, 0))
    assert late.first()["end_date"] == D2
    early = planning.date_ranges(segments, last, cal, as_of, date(2025, 4, 14), date(2025, 4, 18))
    assert {r["segment"]: r["start_date"] for r in early.where("exchange = 'BSE'").collect()} == {"EQ": date(2025, 4, 14), "INDEX": date(2025, 4, 17)}
    with pytest.raises(ValueError):
        planning.date_ranges(segments, last, cal, as_of, D2, D1)
    sunday = planning.date_ranges(segments, last, cal, as_of, date(2025, 7, 12), date(2025, 7, 14))
    assert planning.fetch_manifest(sunday, cal, include_weekends=True).where("segment = 'SME'").count() == 3
    stored = frame(spark, [("NSE", "SME", D1)], "exchange string, segment string, file_date date")
    assert planning.fetch_manifest(sunday, cal, stored=stored).where("segment = 'SME'").count() == 0


def test_coverage(spark):
    names = [("2025-07-14-NSE-EQ.txt", 5), ("2025-13-01-NSE-EQ.txt", 5), ("2025-07-11-NSE-EQ.txt.bak", 0), ("notes.txt", 3), ("2025-07-15-BSE-EQ.csv", 0)]
    stored = coverage.stored_files(frame(spark, names, "file_name string, length long"))
    summary = coverage.segment_summary(specs.segment_table(spark), stored)
    got = {(r["exchange"], r["segment"]): r for r in summary.collect()}
    assert len(got) == 6 and got["NSE", "EQ"]["n_files"] == 3 and got["NSE", "EQ"]["last_date"] == D1 and got["NSE", "EQ"]["is_valid"]
    assert got["BSE", "EQ"]["is_valid"] is False and got["NSE", "SME"]["is_first_run"]
    cal = calendar.calendar(spark, D1, D2, frame(spark, [], "holiday date"))
    covered = coverage.coverage(summary, cal, D2)
    status = coverage.overall_status(covered.where("segment = 'EQ' or segment = 'SME'")).first()
    assert status["reasons"] == "NSE_EQ (Missing 1 days), NSE_SME (No data found)" and not status["all_up_to_date"] and status["last_date"] == D2


def test_error_ladder(spark):
    messages = {"Timeout 404": ("timeout", True), "Connection RESET": ("network", True), "x 503 404": ("server_error", True), "Not Found": ("file_not_found", False), "url/20240404.csv": ("file_not_found", False), "Forbidden": ("access_denied", False), "bad CERT": ("ssl_error", True), "": ("unknown", False), None: ("unknown", False), "odd": ("unknown", False)}
    df = frame(spark, [(m, False) for m in messages], "error_message string, success boolean")
    assert {r["error_message"]: (r["error_type"], r["should_retry"]) for r in fetchlog.classify(df).collect()} == messages


def test_fetch_stats_without_time(spark):
    df = frame(spark, [("a", D1, 1, False, None, 0.0), ("a", D1, 2, False, None, 0.0)], "segment string, target_date date, attempt int, success boolean, file_size long, seconds double")
    r = fetchlog.fetch_stats(df).first()
    assert (r["n_bytes"], r["bytes_per_second"], r["files_per_second"], r["success_rate"], r["n_retries"]) == (0, 0.0, 0.0, 0.0, 1)
    assert fetchlog.completion(df).first()["status"] == "none"


def test_severity(spark):
    cal = calendar.calendar(spark, date(2025, 7, 10), D2, frame(spark, [(date(2025, 7, 11),)], "holiday date"))
    rows = [("NSE_EQ", D1, "404"), ("NSE_EQ", D1, "Timeout"), ("BSE_EQ", D1, "Timeout"), ("NSE_SME", D1, "not available"), ("NSE_EQ", date(2025, 7, 12), "404"), ("NSE_EQ", date(2025, 7, 11), "404"), ("NSE_EQ", D2, "404"), ("NSE_EQ", D1, None)]
    log = frame(spark, [(*r, False, i) for i, r in enumerate(rows)], "segment string, target_date date, error_message string, success boolean, i int")
    got = [r["severity"] for r in coverage.missing_severity(log, cal, specs.segment_table(spark), D2).orderBy("i").collect()]
    assert got == ["critical", "critical", "failed", "notice", "info", "info", "info", "failed"]


def test_profile_and_narrowing(spark):
    df = frame(spark, [(1, 300, 1.5, None), (1, -5, 1.5, "x"), (2, 7, 2.5, None)], "a long, b long, c double, d string")
    got = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert got["d"]["n_distinct"] == 2 and got["a"]["narrow_type"] == "tinyint" and got["b"]["narrow_type"] == "smallint" and got["c"]["narrow_type"] is None
    assert dict(profile.narrow_integers(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "double", "d": "string"}
    assert profile.profile(df.where("false")).first()["use_dictionary"] is False


def test_money_and_empty_rows(spark):
    df = frame(spark, [(0.125,), (None,), (1e7,), (2.675,)], "v double").select(text.money(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["0.13", None, "10000000.00", "2.68"]
    assert append.drop_empty_rows(frame(spark, [("", None), (None, 1), ("a", None)], "a string, b int")).count() == 2


def test_dates_in_names(spark):
    df = frame(spark, [("sme140725.csv",), ("sme140725.txt",), ("x2025-13-01.txt",), ("none",)], "n string")
    sme = specs.SEGMENTS["NSE_SME"]
    got = [(r[0], r[1], r[2]) for r in df.select(dates.raw_name_date(F.col("n"), sme.raw_name, sme.date_format), dates.date_in_name(F.col("n"), "yyyy-MM-dd"), dates.date_in_name(F.col("n"), "unknown")).collect()]
    assert got == [(D1, None, None), (None, None, None), (None, None, None), (None, None, None)]
