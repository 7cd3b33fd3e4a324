"""Files in and out: archives, exports, the lake and arriving segments."""

from __future__ import annotations

import io
import zipfile
from datetime import date
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from eodlake import specs
from eodlake.operators import append, normalize
from eodlake.sources import readers, sinks
from eodlake.streaming import arrivals

HEADER = "TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,Extra\n"


def zipped(*members: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark, tmp_path):
    day = lambda d: f"BhavCopy_NSE_CM_0_0_0_{d}_F_0000.csv.zip"
    line = '2025-07-14,"A,B",EQ,1.5,2,0.5,1,10,x\n2025-07-14,,BE,1,1,1,1,,x\n'
    files = {
        day("20250714"): zipped(("readme.txt", "x"), ("a.csv", HEADER + line), ("b.csv", HEADER)), day("20250715"): zipped(("a.CSV", HEADER + line)),
        day("20250716"): b"not a zip", day("20250717"): zipped(), day("20250718"): zipped(("e.csv", HEADER)), "other.zip": b"x",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    df = readers.read_raw(spark, str(tmp_path), specs.SEGMENTS["NSE_EQ"])
    rows = readers.good(df).orderBy("line_no").collect()
    assert [(r["TckrSymb"], r["OpnPric"], r["TtlTradgVol"], r["file_date"], r["line_no"]) for r in rows] == [("A,B", 1.5, 10, date(2025, 7, 14), 1), (None, 1.0, None, date(2025, 7, 14), 2)]
    assert sorted((r["file_date"].day, r["reason"]) for r in readers.bad(df).collect()) == [(15, "no csv member"), (16, "unreadable: BadZipFile"), (17, "no csv member")]
    assert normalize.nse_eq(readers.good(df)).count() == 2


def test_unreadable_archives_cost_only_their_day(spark, tmp_path):
    day = lambda d: f"BhavCopy_NSE_CM_0_0_0_{d}_F_0000.csv.zip"
    good = zipped(("a.csv", HEADER + "2025-07-14,A,EQ,1,1,1,1,9007199254740993,x\n2025-07-14,B,EQ,1,1,1,1,123.5,x\n" * 40))
    broken = bytearray(good)
    broken[60:75] = b"\xff" * 15
    locked, odd = bytearray(good), bytearray(good)
    at = good.index(b"PK\x01\x02")
    for body, flag, method in ((locked, 1, None), (odd, None, 99)):
        if flag:
            body[6] |= flag
            body[at + 8] |= flag
        if method:
            body[8] = body[at + 10] = method
    for d, body in (("20250714", good), ("20250715", bytes(broken)), ("20250716", bytes(locked)), ("20250717", bytes(odd))):
        (tmp_path / day(d)).write_bytes(body)
    df = readers.read_raw(spark, str(tmp_path / "*.zip"), specs.SEGMENTS["NSE_EQ"])
    assert readers.good(df).groupBy("TtlTradgVol").count().count() == 2 and readers.good(df).where("TtlTradgVol = 9007199254740993").count() == 40
    assert sorted(r["file_date"].day for r in readers.bad(df).collect()) == [15, 16, 17]


def test_plain_and_empty_files(spark, tmp_path):
    (tmp_path / "INDEXSummary_17042025.csv").write_text("IndexID,IndexName,OpenPrice,HighPrice,LowPrice,ClosePrice\n1,BSE SENSEX,1,2,0.5,1.5\n")
    (tmp_path / "INDEXSummary_18042025.csv").write_text("")
    df = readers.read_raw(spark, str(tmp_path), specs.SEGMENTS["BSE_INDEX"])
    assert normalize.bse_index(readers.good(df)).first()["Date"] == "20250417"
    assert readers.bad(df).first()["reason"] == "empty file"


def test_inventory_and_holidays(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "2025-07-14-NSE-EQ.txt").write_text("a")
    (tmp_path / "2025-07-15-NSE-EQ.txt").write_text("")
    got = {r["file_name"]: r["length"] for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert got == {"2025-07-14-NSE-EQ.txt": 1, "2025-07-15-NSE-EQ.txt": 0}
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "list").write_text("26/02/2025\n14/03/2025\n\n26/02/2025\n")
    assert readers.read_holidays(spark, str(tmp_path / "h")).count() == 2


def test_csv_job_counts_bad_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\noops,y\n3,z\n")
    stats = readers.transform_csv(spark, str(tmp_path / "in.csv"), "a int, b string", lambda df: df.where("a > 1"), str(tmp_path / "out"))
    assert stats == {"rows_read": 3, "rows_malformed": 1, "rows_written": 1}


def rows_of(spark, rows):
    return spark.createDataFrame([(s, "20250714", 1.005, 1.0, 1.0, 2.5, 10.0, d, n, seg) for s, d, n, seg in rows], arrivals.SCHEMA)


D1, D2, D3 = date(2025, 7, 14), date(2025, 7, 15), date(2025, 8, 1)


def consolidated(spark):
    rows = rows_of(spark, [("B", D1, 1, "EQ"), ("A", D1, 2, "EQ"), ("S_SME", D1, 1, "SME"), ("I", D1, 1, "INDEX"), ("C", D2, 1, "EQ"), ("Z", D3, 1, "SME")])
    part = lambda s: rows.where(F.col("source_segment") == s).drop("source_segment")
    return append.ordered(append.consolidate("NSE", part("EQ"), {s: part(s) for s in ("SME", "INDEX")}))


def test_export_of_days(spark, tmp_path):
    got = {r["file_name"]: r["content"] for r in sinks.export_days(consolidated(spark), "-NSE-EQ").collect()}
    assert got["2025-07-14-NSE-EQ.txt"].splitlines()[0] == "A,20250714,1.005,1.0,1.0,2.5,10"
    assert got["2025-07-14-NSE-EQ.txt"].splitlines()[2] == "S_SME,20250714,1.01,1.00,1.00,2.50,10"
    sinks.write_days(consolidated(spark), str(tmp_path / "days"), "-NSE-EQ")
    assert (tmp_path / "days" / "2025-07-14-NSE-EQ.txt").read_text() == got["2025-07-14-NSE-EQ.txt"]
    assert sorted(p.name for p in (tmp_path / "days").iterdir() if not p.name.startswith((".", "_"))) == sorted(got)


def test_read_back(spark, tmp_path):
    (tmp_path / "2025-07-14-NSE-EQ.txt").write_text("A,20250714,1,1,1,1,10\n")
    assert readers.read_normalized(spark, str(tmp_path)).first()["file_date"] == D1


def test_combined_files(spark, tmp_path):
    sinks.write_combined(consolidated(spark), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5
    assert (tmp_path / "c" / "NSE_EQ_14072025_combined.csv").read_text().count("\n") == 5


def test_lake_is_idempotent(spark, tmp_path):
    lake = str(tmp_path / "lake")
    for _ in range(2):
        sinks.write_lake(consolidated(spark), lake)
    assert spark.read.parquet(lake).count() == 5
    sinks.write_lake(consolidated(spark).where("file_date >= '2025-08-01'"), lake)
    assert spark.read.parquet(lake).count() == 5


@pytest.mark.parametrize("order", list(permutations(["EQ", "SME", "INDEX"]))[::2])
def test_arrival_order_does_not_matter(spark, tmp_path, order):
    base = str(tmp_path)
    rows = {"EQ": [("B", D1, 1, "EQ"), ("C", D2, 1, "EQ")], "SME": [("S", D1, 1, "SME"), ("Q", D3, 1, "SME")], "INDEX": [("I", D1, 1, "INDEX")]}
    for i, segment in enumerate(order):
        rows_of(spark, rows[segment]).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(arrivals.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        arrivals.stream_consolidate(stream, "NSE", f"{base}/landed", f"{base}/lake", f"{base}/state").awaitTermination()
    got = sorted((r["symbol"], r["row_order"]) for r in spark.read.parquet(f"{base}/lake").collect())
    assert got == [("B", 1), ("C", 1), ("I", 3), ("S", 2)]


def test_a_delivery_may_come_in_several_batches(spark, tmp_path):
    base = str(tmp_path)

    def came(delivery, *rows):
        rows_of(spark, rows).withColumn("delivery", F.lit(delivery).cast("bigint")).repartition(len(rows), "symbol").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(f"{arrivals.SCHEMA}, delivery bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        arrivals.stream_consolidate(stream, "NSE", f"{base}/landed", f"{base}/lake", f"{base}/state").awaitTermination()
        return [(r["symbol"], r["row_order"]) for r in spark.read.parquet(f"{base}/lake").orderBy("row_order").collect()]

    assert came(0, *[(s, D1, n, "EQ") for n, s in enumerate("DBCA")]) == [("A", 1), ("B", 2), ("C", 3), ("D", 4)]
    assert came(1, ("Y", D1, 1, "EQ"), ("X", D1, 2, "EQ")) == [("X", 1), ("Y", 2)]  # the day anew, shorter
