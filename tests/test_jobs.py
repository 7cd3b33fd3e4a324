"""Files under exact names, chunks that fail, markers, waiting days and raw archives as a stream."""

from __future__ import annotations

import io
import zipfile
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.operators import calendar
from eodlake.sources import commits, named, readers, sinks
from eodlake.streaming import arrivals, waiting

D1, D2, D3 = date(2025, 7, 14), date(2025, 7, 15), date(2025, 8, 1)


def lines_of(spark, files):
    rows = [(name, line, i) for name, body in files.items() for i, line in enumerate(body)]
    return spark.createDataFrame(rows, "file_name string, line string, n int").repartition(3)


def names_in(path):
    return sorted(p.name for p in path.iterdir())


# K1, K3


def test_every_line_whatever_the_file_limit(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 4)
    try:
        rows = [(s, "20250714", 1.0, 2.0, 0.5, None, 3.0, "NSE", "EQ", D1, i) for i, s in enumerate(["B,2", None, 'q"x', " s "] * 25)]
        df = spark.createDataFrame(rows, f"{specs.UNIFIED_SCHEMA}, exchange string, segment string, file_date date, row_order bigint")
        sinks.write_combined(df, str(tmp_path / "c"))
        sinks.write_days(df.withColumn("source_segment", F.lit("EQ")), str(tmp_path / "d"), "-NSE-EQ")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert names_in(tmp_path / "c") == ["NSE_EQ_14072025_combined.csv"] and names_in(tmp_path / "d") == ["2025-07-14-NSE-EQ.txt"]
    text = (tmp_path / "c" / "NSE_EQ_14072025_combined.csv").read_text().splitlines()
    assert text[0] == ",".join(specs.UNIFIED) and len(text) == 101
    assert text[1:5] == ['"B,2",20250714,1.0,2.0,0.5,,3.0', ",20250714,1.0,2.0,0.5,,3.0", '"q""x",20250714,1.0,2.0,0.5,,3.0', " s ,20250714,1.0,2.0,0.5,,3.0"]
    assert (tmp_path / "d" / "2025-07-14-NSE-EQ.txt").read_text().splitlines()[:1] == ['"B,2",20250714,1.0,2.0,0.5,,3']


def test_a_failed_job_leaves_the_old_files(spark, tmp_path):
    named.write_named(lines_of(spark, {"a.txt": ["old"], "b.txt": ["old", "too"]}), str(tmp_path), ["n"])
    bad = lines_of(spark, {"a.txt": ["new"], "b.txt": ["new"], "c.txt": ["x"]})
    boom = F.when(F.col("file_name") == "c.txt", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("line"))
    with pytest.raises(Exception, match="boom"):
        named.write_named(bad.withColumn("line", boom), str(tmp_path), ["n"])
    assert (tmp_path / "a.txt").read_text() == "old\n" and (tmp_path / "b.txt").read_text() == "old\ntoo\n" and not (tmp_path / "c.txt").exists()
    named.write_named(lines_of(spark, {"a.txt": ["new"]}), str(tmp_path), ["n"])
    assert (tmp_path / "a.txt").read_text() == "new\n" and (tmp_path / "b.txt").read_text() == "old\ntoo\n"
    assert [n for n in names_in(tmp_path) if not n.startswith(named.STAGING)] == ["a.txt", "b.txt"]


def test_a_move_that_fails_loses_nothing(tmp_path):
    (tmp_path / "a.txt").mkdir()  # nothing can take this name
    (tmp_path / "a.txt" / "kept").write_text("old")
    writer = named.NamedFilesWriter(f"file://{tmp_path}", None)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a.txt", "a.txt", "b.txt"]), pa.array(["1", "2", "3"])], names=["file_name", "line"])
    done = writer.write(iter([batch]))
    system, base = named.opened(f"file://{tmp_path}")

    class Refusing:
        def __getattr__(self, name):
            return getattr(system, name)

        def move(self, a, b):
            raise OSError("no")

    real, named.opened = named.opened, lambda uri: (Refusing(), base)
    try:
        with pytest.raises(OSError):
            writer.commit([done])
    finally:
        named.opened = real
    assert (tmp_path / "a.txt" / "kept").read_text() == "old"
    assert sorted(p.read_text() for p in (tmp_path / writer.staging).rglob("*") if p.is_file()) == ["1\n2\n", "3\n"]


def test_two_writers_do_not_meet(tmp_path):
    import pyarrow as pa

    one, two = (named.NamedFilesWriter(f"file://{tmp_path}", None) for _ in range(2))
    batch = lambda v: pa.record_batch([pa.array(["a.txt", f"{v}.txt"]), pa.array([v, v])], names=["file_name", "line"])
    first, second = one.write(iter([batch("one")])), two.write(iter([batch("two")]))
    one.commit([first])
    two.commit([second, None])
    assert names_in(tmp_path) == ["a.txt", "one.txt", "two.txt"] and (tmp_path / "a.txt").read_text() == "two\n"
    again = named.NamedFilesWriter(f"file://{tmp_path}", None)
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([again.write(iter([batch("x")])), again.write(iter([batch("y")]))])
    again.abort([])
    assert names_in(tmp_path) == ["a.txt", "one.txt", "two.txt"]


@pytest.mark.parametrize("name", ["x/y", None, "_x", ".x"])
def test_names_that_are_none(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a file's name"):
        named.write_named(spark.createDataFrame([(name, "l", 1)], "file_name string, line string, n int"), str(tmp_path), ["n"])


# S7, X2


def test_failing_chunks_are_recorded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n" + "".join(f"{i},{i % 7}\n" for i in range(25)) + "oops,1\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n" + "".join(f"{i},1\n" for i in range(100, 104)))
    calls = spark.sparkContext.accumulator(0)

    def fn(chunk):
        calls.add(1)
        if (chunk["k"] == 12).any():
            raise KeyError("twelve")
        if (chunk["k"] == 22).any():
            return chunk.assign(w="text")  # not a number
        return chunk.assign(w=chunk["v"] * 2.0).iloc[:, ::-1]

    counts, faults = readers.transform_chunks(spark, str(tmp_path / "in"), "k long, v long", fn, "k long, w double", str(tmp_path / "out"), chunk_rows=10)
    got = sorted((r["file_name"], r["block_start"], r["chunk"], r["first_row"], r["n_rows"], r["reason"].split(":")[0]) for r in faults.collect())
    assert got == [("a.csv", 0, 1, 10, 10, "KeyError"), ("a.csv", 0, 2, 20, 5, got[1][5])]
    assert counts == {"rows_read": 30, "rows_malformed": 1, "chunks": 4, "chunks_failed": 2, "rows_failed": 15, "rows_written": 14}
    rows = sorted(tuple(r) for r in spark.read.schema("k long, w double").csv(str(tmp_path / "out"), header=True).collect())
    assert rows == sorted([(i, 2.0 * (i % 7)) for i in range(10)] + [(i, 2.0) for i in range(100, 104)])
    assert calls.value == 4  # once each
    with pytest.raises(ValueError, match="_chunk"):
        readers.transform_chunks(spark, str(tmp_path / "in"), "k long, _chunk long", fn, "k long", str(tmp_path / "o2"))


def test_many_small_chunks_cost_little_each(spark, tmp_path):
    import time

    spark.range(40_000, numPartitions=1).selectExpr("id AS k", "timestamp_seconds(id) AS t").write.csv(str(tmp_path / "in"), header=True)

    def fn(chunk):
        assert list(chunk.index) == list(range(len(chunk))) and str(chunk["t"].dtype) == "datetime64[ns]"
        return chunk[["t", "k"]]

    start = time.monotonic()
    counts, faults = readers.transform_chunks(spark, str(tmp_path / "in"), "k long, t timestamp", fn, "k long, t timestamp", str(tmp_path / "out"), chunk_rows=4)
    assert counts["chunks"] == 10_000 and counts["rows_written"] == 40_000 and faults.count() == 0
    assert time.monotonic() - start < 100  # 15 ms a chunk before, on the machine where this took 28 seconds
    out = spark.read.schema("k long, t timestamp").csv(str(tmp_path / "out"), header=True)
    assert out.where("t = timestamp_seconds(k)").count() == 40_000


# J10


UNITS = "exchange string, segment string, file_date date, source_segment string, symbol string"


def test_appended_once(spark, tmp_path):
    lake = str(tmp_path / "lake")
    df = lambda *rows: spark.createDataFrame([("NSE", "EQ", *r) for r in rows], UNITS)
    stored = lambda: sorted(str(tuple(r)[2:]) for r in commits.committed(spark, lake, UNITS).collect())
    assert stored() == [] and commits.append_once(df(), lake) == 0
    day = [(D1, "EQ", "A"), (D1, "EQ", None), (D1, "INDEX", "I")]
    assert commits.append_once(df(*day), lake) == 2
    want = stored()
    assert len(want) == 3 and commits.append_once(df(*day), lake) == 0 and stored() == want
    # stopped between data and markers: nothing is there, the next run adds it, and what was left can be deleted
    commits.write_rows(df((D2, "EQ", "B"), (D2, "SME", "S")), lake, f"{1:020d}-stopped")
    assert stored() == want
    assert commits.append_once(df(*day, (D2, "EQ", "B"), (D2, "SME", "S"), (None, None, "odd")), lake) == 3
    want = stored()
    assert len(want) == 6
    # another run that has written the same units and marks them late adds nothing
    late = commits._new_run()
    commits.write_rows(df((D2, "EQ", "B")), lake, late)
    commits.write_markers(spark, lake, late)
    assert stored() == want and commits.append_once(df(*day, (D2, "EQ", "B"), (None, None, "odd")), lake) == 0
    assert commits.repair(spark, lake) == [f"{1:020d}-stopped", *[r for r in commits.repair(spark, lake, 1e12)]]
    assert stored() == want


def test_new_symbols_of_a_day(spark):
    stored = spark.createDataFrame([(D1, "A", 1), (D1, None, 1), (D2, "B", 1)], "file_date date, symbol string, v int")
    more = spark.createDataFrame([(D1, "A", 2), (D1, "B", 2), (D1, None, 2), (D2, "A", 2), (D2, "B", 2), (D2, None, 2)], "file_date date, symbol string, v int")
    got = sorted(str(tuple(r)) for r in commits.new_symbols(more, stored).collect())
    assert got == sorted(map(str, [(D1, "B", 2), (D2, "A", 2), (D2, None, 2)]))


# ST2, ST3


def test_days_are_given_once_and_forgotten(spark, tmp_path):
    kind = "exchange string, file_date date, source_segment string, n_rows bigint, arrived timestamp"
    at = lambda day, hour=0: datetime(2025, 7, day, hour)
    base = str(tmp_path)

    def came(*rows):
        spark.createDataFrame([("NSE", *r) for r in rows], kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        waiting.stream_days(spark, stream, f"{base}/out", f"{base}/state").awaitTermination()
        rows = spark.read.schema(waiting.STATUS).parquet(f"{base}/out").collect()
        return sorted((r["file_date"].day, r["status"], r["segments"], r["n_rows"]) for r in rows)

    d = lambda n: date(2025, 7, n)
    first = came((d(1), "EQ", 5, at(1)), (d(2), "SME", 2, at(2)))
    assert first == [(1, "pending", "EQ", 5), (2, "pending", "SME", 2)]
    done = came((d(1), "SME", 1, at(2)), (d(1), "INDEX", 3, at(2)), (d(1), "EQ", 5, at(2)))
    assert [x for x in done if x not in first] == [(1, "complete", "EQ,INDEX,SME", 9)]
    assert came((d(1), "EQ", 6, at(3))) == done  # a day is given once
    late = came((d(20), "EQ", 1, at(20)))
    late = came((d(21), "EQ", 1, at(21)))
    assert [x for x in late if x[0] == 2] == [(2, "expired", "SME", 2), (2, "pending", "SME", 2)]
    held = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "given").load()
    assert sorted(r["key"]["file_date"].day for r in held.collect()) == [20, 21]
    last = {r["file_date"].day: r["status"] for r in waiting.last_statuses(spark, f"{base}/out").collect()}
    assert last == {1: "complete", 2: "expired", 20: "pending", 21: "pending"}


# ST1, S1


def test_raw_archives_as_a_stream(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path)
    eq = "TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n2025-07-14,B,EQ,1,1,1,1,5\n2025-07-14,A,BE,1,1,1,1,5\n2025-07-14,X,GS,1,1,1,1,5\n"

    def zipped(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("x.csv", text)
        return out.getvalue()

    def put(folder, name, body):
        (raw / folder).mkdir(parents=True, exist_ok=True)
        (raw / folder / name).write_bytes(body)

    def run():
        arrivals.stream_archives(spark, str(raw), "NSE", f"{base}/landed", f"{base}/lake", f"{base}/bad", f"{base}/state", files_per_batch=2).awaitTermination()
        try:
            return [(r["file_date"].day, r["symbol"], r["row_order"]) for r in spark.read.parquet(f"{base}/lake").orderBy("file_date", "row_order").collect()]
        except Exception:  # no lake yet
            return []

    put("i", "ind_close_all_14072025.csv", b"Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value,Volume\nNifty,14-07-2025,1,1,1,1,7\n")
    put("i", "notes.txt", b"not a segment")
    put("s", "sme140725.csv", b"SYMBOL,OPEN_PRICE,HIGH_PRICE,LOW_PRICE,CLOSE_PRICE,NET_TRDQTY\nS,1,1,1,1,5\n")
    put("e", "BhavCopy_NSE_CM_0_0_0_20250715_F_0000.csv.zip", zipped(eq)[:40])
    put("e", "BhavCopy_NSE_CM_0_0_0_20250716_F_0000.csv.zip", b"")
    assert run() == []
    put("e", "BhavCopy_NSE_CM_0_0_0_20250714_F_0000.csv.zip", zipped(eq))
    want = [(14, "A", 1), (14, "B", 2), (14, "S_SME", 3), (14, "Nifty", 4)]
    assert run() == want == run()
    bad = sorted((r["file_date"].day, r["reason"]) for r in arrivals.quarantined(spark, f"{base}/bad", str(raw)).collect())
    assert bad == [(15, "unreadable: BadZipFile"), (16, "empty file")]
    put("e2", "BhavCopy_NSE_CM_0_0_0_20250715_F_0000.csv.zip", zipped(eq))  # the damaged one anew
    assert run() == [*want, (15, "A", 1), (15, "B", 2)]


def test_a_folder_goes_to_the_lake_in_one_batch(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path)
    (raw / "x").mkdir(parents=True)
    eq = "TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n2025-07-14,B,A,1,1,1,1,5\n2025-07-14,DENIED,A,1,1,1,1,5\n2025-07-14,A,F,1,1,1,1,5\n"
    (raw / "x" / "BhavCopy_BSE_CM_0_0_0_20250714_F_0000.CSV").write_text(eq)
    (raw / "INDEXSummary_14072025.csv").write_text("IndexName,OpenPrice,HighPrice,LowPrice,ClosePrice\nBSE SENSEX,1,2,0.5,1.5\n")
    (raw / "INDEXSummary_15072025.csv").write_text("")
    for batch in (0, 0, 1):
        arrivals.ingest(spark, str(raw), "BSE", f"{base}/landed", f"{base}/lake", f"{base}/bad", batch, denied=["DENIED"])
        got = spark.read.parquet(f"{base}/lake").orderBy("row_order").collect()
        assert [(r["symbol"], r["source_segment"], r["volume"], r["row_order"]) for r in got] == [("B", "EQ", 5.0, 1), ("BSE SENSEX", "INDEX", 0.0, 2)]
    assert [(r["file_date"], r["reason"]) for r in arrivals.quarantined(spark, f"{base}/bad", str(raw)).collect()] == [(D2, "empty file")]


def test_segments_of_one_pass_keep_their_columns(spark):
    files = [("sme140725.csv", b"SYMBOL,OPEN_PRICE\nS,1.5\n"), ("INDEXSummary_14072025.csv", b"IndexName,OpenPrice\nI,2\n"), ("other", b"x")]
    df = spark.createDataFrame(files, "file_name string, content binary")
    chosen = [specs.SEGMENTS["NSE_SME"], specs.SEGMENTS["BSE_INDEX"]]
    parsed = readers.parse_segments(df, chosen)
    assert [tuple(r)[:2] for r in readers.of_segment(parsed, chosen[0]).collect()] == [("S", 1.5)]
    one = readers.of_segment(parsed, chosen[1]).first()
    assert (one["IndexName"], one["OpenPrice"], one["ClosePrice"], one["file_date"]) == ("I", 2.0, None, D1) and parsed.count() == 2


# D10, J7


def test_dates_outside_the_calendar_are_errors(spark):
    none = spark.createDataFrame([], "holiday date")
    cal = calendar.calendar(spark, D1, D2, none, pad=0)
    inside = spark.createDataFrame([(D1, D2), (None, D2), (D2, D1)], "s date, e date")
    outside = spark.createDataFrame([(D1, D3)], "s date, e date")
    assert [r["n_trading_days"] for r in calendar.count_trading_days(inside, cal, "s", "e").collect()] == [2, None, 0]
    assert calendar.trading_days(inside, cal, "s", "e").count() == 2
    for f in (calendar.count_trading_days, calendar.trading_days):
        with pytest.raises(Exception, match="outside the calendar"):
            f(outside, cal, "s", "e").collect()
    with pytest.raises(Exception, match="outside the calendar"):
        calendar.month_trading_days(cal, 2025, 7).collect()
    own = calendar.calendar_for(outside, ["s", "e"], none)
    assert calendar.trading_days(outside, own, "s", "e").count() == 15 and calendar.month_trading_days(own, 2025, 7).count() == 23
    assert calendar.calendar_for(outside.where("s is null"), ["s", "e"], none).count() == 0


# Only the files that are asked for


def test_one_month_opens_one_months_files(spark, tmp_path):
    from eodlake.sources import segments

    for month in range(1, 13):
        for day in range(1, 29):
            (tmp_path / f"m{month}").mkdir(exist_ok=True)
            (tmp_path / f"m{month}" / f"sme{day:02d}{month:02d}25.csv").write_text("SYMBOL,NET_TRDQTY\nA,1\nB,2\n" if (month, day) != (3, 13) else "")
    (tmp_path / "ind_close_all_01032025.csv").write_text("Index Name,Volume\nN,7\n")
    (tmp_path / "sme993125.csv").write_text("SYMBOL\nZ\n")  # no day of that name
    (tmp_path / "other.txt").write_text("x")
    year = segments.read_segments(spark, str(tmp_path), ["NSE_SME", "NSE_INDEX", "XSE_EQ"], partition_bytes=1)
    opened = lambda df: df.rdd.getNumPartitions()  # noqa: E731  a file each
    assert opened(year) == 12 * 28 + 2
    march = year.where((F.col("file_date") >= date(2025, 3, 1)) & (F.col("file_date") < date(2025, 4, 1)))
    assert opened(march) == 29 and opened(march.where("segment_name = 'NSE_SME'")) == 28
    assert opened(year.where(F.col("file_date").isin(D1, D2))) == 2
    assert opened(year.where(F.col("file_date") == D3).where("SYMBOL = 'A'")) == 1
    rows = march.where("segment_name = 'NSE_SME'")
    assert readers.good(rows).count() == 54 and [tuple(r)[1:] for r in readers.bad(rows).collect()] == [(date(2025, 3, 13), "empty file")]
    assert sorted(tuple(r) for r in readers.good(march).where("line_no = 1 AND file_date = '2025-03-01'").select("segment_name", "SYMBOL", "`Index Name`", "Volume").collect()) == [("NSE_INDEX", None, "N", 7), ("NSE_SME", "A", None, None)]
    assert year.where("file_date is null").count() == 1 and opened(year.where("file_date > '2026-01-01'")) == 1  # one task without files


# S2


def test_plain_files_of_several_splits_keep_their_order(spark, tmp_path):
    head = {"sme140725.csv": "﻿SYMBOL,OPEN_PRICE,X,NET_TRDQTY", "sme150725.csv": "NET_TRDQTY,SYMBOL"}
    body = {"sme140725.csv": [f'"S,{i}", {i}.5 ,x,{i}' for i in range(900)], "sme150725.csv": ["9007199254740993,A", "12.0,", "", "1.5, B ", "x,\"q\"\"\"", "3"]}
    for name, lines in body.items():
        (tmp_path / name).write_text("\n".join([head[name], *lines]) + "\n", encoding="utf-8")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    spec = specs.SEGMENTS["NSE_SME"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_plain(spark, str(tmp_path), spec)
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.select("file_date", "line_no", "SYMBOL", "OPEN_PRICE", "NET_TRDQTY").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(D1, i + 1, f"S,{i}", i + 0.5, i) for i in range(900)]
    want += [(D2, 1, "A", None, 9007199254740993), (D2, 2, None, None, 12), (D2, 3, "B", None, None), (D2, 4, 'q"', None, None), (D2, 5, None, None, 3)]
    assert got == want
    raw = readers.good(readers.read_raw(spark, str(tmp_path), spec)).select("file_date", "line_no", "SYMBOL", "OPEN_PRICE", "NET_TRDQTY")
    assert sorted(map(tuple, raw.collect()), key=str) == sorted(want, key=str)


# A10


def test_sketches_merge_and_stored_days_stay(spark, tmp_path):
    from eodlake.operators import profile

    rows = spark.range(20_000).selectExpr("date_add(date'2025-01-01', cast(id % 30 as int)) AS file_date", "id AS k", "cast(id % 7 as int) AS small", "if(id % 10 = 0, null, concat('s', id % 500)) AS s", "id / 3.0 AS x")
    path, columns = str(tmp_path / "p"), ["k", "small", "s", "x"]
    profile.add_days(rows.where("file_date < '2025-01-11'"), path, columns)
    poisoned = rows.where("file_date < '2025-01-11'").withColumn("k", F.raise_error(F.lit("read again")).cast("bigint"))
    stored = profile.add_days(poisoned.union(rows.where("file_date >= '2025-01-11'")), path, columns)
    assert stored.count() == 30 * 4 and profile.add_days(rows, path, columns).count() == 120
    got, want = ({r["column_name"]: r.asDict() for r in df.collect()} for df in (profile.merged_profile(stored), profile.profile(rows, columns)))
    for c in columns:
        n, m = got[c].pop("n_distinct"), want[c].pop("n_distinct")
        assert abs(n - m) <= 0.05 * m and {**got[c], "type": ""} == {**want[c], "type": ""}


# O3, K4


def test_lake_takes_one_shuffle(spark, tmp_path):
    from eodlake.operators import append

    kind = "symbol string, file_date date, line_no bigint, source_segment string, source_rank int, exchange string, segment string"
    rows = [("B", D1, 1, "EQ", 0, "NSE", "EQ"), (None, D1, 2, "EQ", 0, "NSE", "EQ"), ("A", D1, 3, "EQ", 0, "NSE", "EQ"), ("Z", D1, 2, "SME", 1, "NSE", "EQ"), ("A", D3, 1, "EQ", 0, "NSE", "EQ"), ("C", D2, 1, "EQ", 0, "NSE", "EQ")]
    df = spark.createDataFrame(rows, kind)
    assert append.ordered_by_month(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(append.ordered_by_month(df).drop("file_month").collect(), key=str) == sorted(append.ordered(df).collect(), key=str)
    for _ in range(2):
        sinks.write_ordered(df, str(tmp_path / "lake"))
    assert sorted((r["symbol"] or "", r["row_order"]) for r in spark.read.parquet(str(tmp_path / "lake")).collect()) == [("", 3), ("A", 1), ("A", 1), ("B", 2), ("C", 1), ("Z", 4)]


def test_constant_exchange_takes_one_shuffle_and_one_sort(spark, tmp_path):
    from eodlake.operators import append

    rows = spark.createDataFrame([(s, D1, n, 1.0) for n, s in enumerate("BCA")], "symbol string, file_date date, line_no bigint, open double")
    every = rows.selectExpr("symbol", "'20250714' AS trade_date", "open", "open AS high", "open AS low", "open AS close", "1D AS volume", "file_date", "line_no")
    plan = append.ordered_by_month(append.consolidate("NSE", every, {"SME": every}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning(") == 2  # the rows once, and the equity days
    # the sort of the order in the days is that of the lake's folders
    assert plan.count("Sort [") == 1 and plan.split("Sort [")[1].startswith("exchange") and ["segment", "file_month", "file_date"] == [c.strip().split("#")[0] for c in plan.split("Sort [")[1].split(",")[1:4]]
    assert "SortMergeJoin" not in plan
    sinks.write_ordered(append.consolidate("NSE", every, {"SME": every}), str(tmp_path / "lake"))
    lake = spark.read.parquet(str(tmp_path / "lake"))
    assert [(r["symbol"], r["row_order"]) for r in lake.collect()] == [("A", 1), ("B", 2), ("C", 3), ("B", 4), ("C", 5), ("A", 6)]


# S1, S2


def test_plain_texts_are_parsed_by_columns_as_line_by_line(spark):
    from pyspark.sql.pandas.types import to_arrow_schema

    spec, head = specs.SEGMENTS["NSE_SME"], b"SYMBOL,OPEN_PRICE,NET_TRDQTY\n"
    out, patterns = readers.segment_schema([spec]), readers.name_patterns([spec])
    arrow = to_arrow_schema(out)
    plain = [b" A ,nan, 7 \nB,inf,12.0\nC,-1e3,x\n", b"\n\nA,1,2\n\n", b"A,0x1F,0x1F\n", "é　, 1.25,1_000\n".encode(), b"A,,\r\n,,\r\n", b"A,0.1,2", b"A,+5,+5\n", b"N/A,NULL,NA\n"]
    odd = [b"A,1\n", b"A,1,2,3\n", b"A,1,2\rB,1,2\n", b'"A,1",1,2\n', b"\xff,1,2\n", b"", b" \nA,1,2\n", b"a\0b,1,2\n"]
    for body in plain + odd:
        assert (readers._plain_table(head + body) is not None) == (body in plain), body
        found = readers.parsed_batch("sme140725.csv", head + body, patterns, out, arrow)
        data = readers.parsed_columns("sme140725.csv", head + body, patterns, out)
        want = data and pa.record_batch([pa.array(list(data[f.name]), f.type) for f in arrow], schema=arrow).to_pylist()
        assert str(found and found.to_pylist()) == str(want), body
