"""Readers of raw and stored files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eodlake import specs
from eodlake.functions.dates import raw_name_date
from eodlake.sources.scratch import shared_folder

BAD = "_bad_file"


def _cast(values: list[str | None], kind: T.DataType) -> list:
    if isinstance(kind, T.StringType):
        return [v or None for v in values]
    if isinstance(kind, T.LongType):
        return [_whole(v) for v in values]
    number = pd.to_numeric(pd.Series(values, dtype="object"), errors="coerce")
    return [None if pd.isna(v) else float(v) for v in number]


def _whole(value: str | None) -> int | None:
    """A whole number as it stands, however long; a broken one is none."""
    try:
        return int(value)
    except (TypeError, ValueError):
        pass
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return int(number) if number.is_integer() else None


def _csv_rows(content: bytes) -> tuple[list[str], list[list[str]]]:
    lines = csv.reader(io.StringIO(content.decode("utf-8-sig")))
    header = next(lines, [])
    return [h.strip() for h in header], [row for row in lines if row]


def _first_csv(content: bytes) -> bytes | None:
    """The first member whose name ends with a lower-case .csv."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.endswith(".csv")]
        return z.read(names[0]) if names else None


def read_raw(spark: SparkSession, path: str, spec: specs.SegmentSpec) -> DataFrame:
    """A folder of one segment's files, by `parse_files`."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    empty = empty_files(spark, path).select("file_name", F.lit(b"").alias("content"))
    return parse_files(files.unionByName(empty), spec)


def parse_files(files: DataFrame, spec: specs.SegmentSpec) -> DataFrame:
    """(file_name, content) -> the spec's columns, file_date, line_no, file_name, _bad_file, by `parse_segments`."""
    return parse_segments(files, [spec]).drop("segment_name")


def segment_schema(chosen: list[specs.SegmentSpec]) -> T.StructType:
    """The segments' columns together, then segment_name, file_name, line_no, _bad_file."""
    fields: dict[str, T.StructField] = {}
    for spec in chosen:
        for f in T.StructType.fromDDL(spec.schema):
            if fields.setdefault(f.name, f) != f:
                raise ValueError(f"segments differ in the type of {f.name}")
    return T.StructType([*fields.values(), T.StructField("segment_name", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField(BAD, T.StringType())])


def name_patterns(chosen: list[specs.SegmentSpec]) -> list[tuple[re.Pattern, specs.SegmentSpec, set[str]]]:
    return [(re.compile(s.raw_name), s, {f.name for f in T.StructType.fromDDL(s.schema)}) for s in chosen]


#: What Python strips from a text.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _plain_table(content: bytes) -> pa.Table | None:
    """The lines of a text without quotes, all as wide as its header, as columns of stripped texts (null: nothing); None if it isn't such a one, and is for
    `_csv_rows`."""
    if b'"' in content or content.count(b"\r") != content.count(b"\r\n") or b"\0" in content:
        return None
    head, _, body = content.partition(b"\n")
    try:
        header = [h.strip() for h in head.decode("utf-8-sig").rstrip("\r").split(",")]
        if not head.strip() or not body.strip(b"\r\n"):
            return None
        at = [str(i) for i in range(len(header))]
        read = pacsv.ReadOptions(column_names=at, use_threads=False, block_size=max(len(body), 1))
        found = pacsv.read_csv(pa.BufferReader(body), read, pacsv.ParseOptions(quote_char=False), pacsv.ConvertOptions(column_types={c: pa.string() for c in at}, strings_can_be_null=False))
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return None
    if body.startswith(b"\xef\xbb\xbf") or len(body) > (1 << 30) or any((pc.max(pc.binary_length(c)).as_py() or 0) > csv.field_size_limit() for c in found.columns):
        return None
    columns: dict[str, pa.Array] = {}
    for name, c in zip(header, found.columns, strict=True):
        if name not in columns:
            text = pc.utf8_trim(c.combine_chunks(), characters=BLANKS)
            columns[name] = pc.if_else(pc.equal(text, ""), None, text)
    return pa.table(columns)


def _cast_column(text: pa.Array, kind: T.DataType) -> pa.Array:
    """`_cast` of a whole column; texts that Arrow can't take are for Python."""
    if isinstance(kind, T.StringType):
        return text
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.float64()
    try:
        if isinstance(kind, T.LongType) and pc.any(pc.match_substring(text, "x", ignore_case=True)).as_py():
            raise pa.ArrowInvalid("hexadecimal digits")
        number = text.cast(arrow)
        return number if isinstance(kind, T.LongType) else pc.if_else(pc.is_nan(number), None, number)
    except pa.ArrowInvalid:
        return pa.array(_cast(text.to_pylist(), kind), arrow)


def parsed_batch(name: str, content: bytes | None, patterns: list[tuple[re.Pattern, specs.SegmentSpec, set[str]]], out: T.StructType, arrow: pa.Schema) -> pa.RecordBatch | None:
    """`parsed_columns` as a batch; plain texts column by column."""
    spec, own = next((s, own) for p, s, own in patterns if p.search(name))
    table = None
    try:
        content = bytes(content or b"")
        text = _first_csv(content) if spec.zipped and content else content
        table = _plain_table(text) if text else None
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError):
        pass  # `parsed_columns` gives the reason
    if table is None:
        data = parsed_columns(name, content, patterns, out)
        return data and pa.record_batch([pa.array(list(data[f.name]), f.type) for f in arrow], schema=arrow)
    n = table.num_rows
    columns = [_cast_column(table[f.name].combine_chunks(), f.dataType) if f.name in own and f.name in table.column_names else pa.nulls(n, at.type) for f, at in zip(out.fields[:-4], arrow, strict=False)]
    return pa.record_batch([*columns, pa.repeat(spec.name, n), pa.repeat(name, n), pa.array(range(1, n + 1), pa.int64()), pa.nulls(n, pa.string())], schema=arrow)


def parsed_columns(name: str, content: bytes | None, patterns: list[tuple[re.Pattern, specs.SegmentSpec, set[str]]], out: T.StructType) -> dict[str, object] | None:
    """One file's rows as columns of `out`, one row with a reason if it can't be read, None if it has no rows."""
    spec, own = next((s, own) for p, s, own in patterns if p.search(name))
    reason, header, rows = None, [], []
    try:
        if not content:
            reason = "empty file"
        elif spec.zipped and (content := _first_csv(bytes(content))) is None:
            reason = "no csv member"
        else:
            header, rows = _csv_rows(bytes(content))
    # a damaged stream, an encrypted member, an unknown method: RuntimeError has the last two
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, UnicodeDecodeError, csv.Error) as e:
        reason = f"unreadable: {type(e).__name__}"
    n = 1 if reason else len(rows)
    if not n:
        return None
    data: dict[str, object] = {}
    for f in out.fields[:-4]:
        at = header.index(f.name) if f.name in header and f.name in own else None
        values = [None] * n if reason or at is None else [r[at].strip() if at < len(r) else None for r in rows]
        data[f.name] = _cast(values, f.dataType)
    return data | {"segment_name": [spec.name] * n, "file_name": [name] * n, "line_no": range(1, n + 1), BAD: [reason] * n}


def parse_segments(files: DataFrame, chosen: list[specs.SegmentSpec]) -> DataFrame:
    """(file_name, content) of any of the segments -> all their columns, segment_name, file_date, line_no, file_name, _bad_file, in one pass
    over the files; a file belongs to the first segment whose names match, others are left out.

    Files are taken whole, as archives cannot be split and line numbers are needed, many to a task.  A
    file that can't be read gives one row with the reason in `_bad_file` and does not hold up the others;
    `good` and `bad` part them.  Columns that are absent in a file are null."""
    out, patterns = segment_schema(chosen), name_patterns(chosen)

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small files are handed on together
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for name, content in zip(batch.column("file_name").to_pylist(), batch.column("content"), strict=True):
                if (rows := parsed_batch(name, content.as_py(), patterns, out, arrow)) is not None:
                    held.append(rows)
                    if sum(r.num_rows for r in held) >= 20_000:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    known = reduce(lambda a, b: a | b, [F.col("file_name").rlike(s.raw_name) for s in chosen])
    rows = files.where(known).select("file_name", "content").mapInArrow(run, out)
    day = reduce(lambda c, s: c.when(F.col("segment_name") == s.name, raw_name_date(F.col("file_name"), s.raw_name, s.date_format)), chosen, F)
    return rows.withColumn("file_date", day)


def of_segment(parsed: DataFrame, spec: specs.SegmentSpec) -> DataFrame:
    """The good rows of one segment, in its own columns."""
    rows = parsed.where((F.col("segment_name") == spec.name) & F.col(BAD).isNull())
    return rows.select(*[F.col(f"`{f.name}`") for f in T.StructType.fromDDL(spec.schema)], "file_date", "line_no")


def good(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNull()).drop(BAD, "file_name")


def bad(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNotNull()).select("file_name", "file_date", F.col(BAD).alias("reason"))


def read_plain(spark: SparkSession, path: str, spec: specs.SegmentSpec) -> DataFrame:
    """S2 for large plain files: the spec's columns, file_date and line_no, as `parse_files` gives them, but on the JVM and with files cut to splits.

    A line's number is its place in its split and the lines of the splits before: a first pass counts the lines of each split and finds each file's
    header (one small row per split), a second one reads them.  Columns are found by each file's own header.  A field must not hold a line end; files
    in archives, and those without a byte, are for `read_raw`."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_block"))
    # numbers of one split follow each other in the order of its lines, in both passes
    lines = lines.where((F.trim("value") != "") & F.col("_name").rlike(spec.raw_name)).withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_head"))
    order = Window.partitionBy("_path").orderBy("_block")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_block", (before - F.col("_first")).alias("_shift"), F.regexp_replace(F.first("_head").over(order), "^\ufeff", "").alias("_header"))
    width = splits.agg(F.max(F.length("_header") - F.length(F.replace("_header", F.lit(","))) + 1)).first()[0] or 1
    fields = lambda c: F.array(*[F.trim(F.from_csv(c, ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})[f"c{i}"]) for i in range(width)])
    splits = splits.withColumn("_columns", fields("_header")).drop("_header")
    met = lines.withColumnsRenamed({"_path": "_p", "_block": "_b"}).join(splits, (F.col("_p") == F.col("_path")) & (F.col("_b") == F.col("_block")))
    met = met.withColumn("line_no", F.col("_at") + F.col("_shift")).where("line_no > 0").withColumn("_fields", fields("value"))
    out = []
    for f in T.StructType.fromDDL(spec.schema):
        at = F.array_position("_columns", F.lit(f.name)).cast("int")
        text = F.when(at > 0, F.nullif(F.try_element_at("_fields", at), F.lit("")))
        number = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
        if isinstance(f.dataType, T.LongType):
            text = F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
        elif not isinstance(f.dataType, T.StringType):
            text = number
        out.append(text.alias(f.name))
    return met.select(*out, raw_name_date(F.col("_name"), spec.raw_name, spec.date_format).alias("file_date"), "line_no")


def read_holidays(spark: SparkSession, path: str, iso: bool = False) -> DataFrame:
    """S3."""
    from eodlake.operators.calendar import parse_holidays

    return parse_holidays(spark.read.text(path), "value", iso)


def empty_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_name, length, modificationTime) of files without a byte, which Spark's readers leave out.

    Names come from the file system's own listing of a folder or pattern, as Spark's index of a folder does: on the driver, a few calls
    per file, for the some ten thousand daily files of a history."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(hadoop) or []:
        files = fs.listFiles(top.getPath(), recursive)
        while files.hasNext():
            f = files.next()
            if not f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().getName(), 0, f.getModificationTime()))
    df = spark.createDataFrame(found, "file_name string, length bigint, ms bigint")
    return df.select("file_name", "length", F.timestamp_millis("ms").alias("modificationTime"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, names and sizes only; `coverage.stored_files` reads their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime").unionByName(empty_files(spark, path, recursive=True))


def read_normalized(spark: SparkSession, path: str, schema: str = specs.UNIFIED_SCHEMA) -> DataFrame:
    """Headerless files named by their day."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=False)
    return df.withColumn("file_date", F.to_date(F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2}-\d{2})-", 1)))


def transform_csv(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], output: str) -> dict[str, int]:
    """A big CSV through a caller's function; malformed lines are counted and left out.
    -> rows read, malformed, written."""
    read, written = Observation("read"), Observation("written")
    raw = spark.read.schema(f"{schema}, _corrupt_record string").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    seen = raw.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))
    out = transform(seen.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))
    out.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").csv(output, header=True)
    return {"rows_read": read.get["rows"], "rows_malformed": read.get["bad"], "rows_written": written.get["rows"]}


FAULTS = "file_name string, block_start bigint, chunk bigint, first_row bigint, n_rows bigint, reason string"


def transform_chunks(
    spark: SparkSession, path: str, schema: str, transform: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str, output: str, chunk_rows: int = 10_000
) -> tuple[dict[str, int], DataFrame]:
    """A big CSV through a caller's pandas function, chunk by chunk.  -> counts, and a row of FAULTS per chunk whose function
    raised or whose result doesn't fit `out_schema`; all others are written to `output`.

    A chunk is `chunk_rows` successive rows of a file's block (a split of Spark's reader), the last of a block may be shorter; chunks and rows are
    numbered from 0 in their block.  The function runs once per chunk: its results and the faults go to one table in the shared folder first, so neither
    the counts nor the files come from a second run of it.  A task holds one chunk."""
    fields = T.StructType.fromDDL(out_schema)
    taken = {f.name.lower() for f in [*fields, *T.StructType.fromDDL(schema)]} | {"_corrupt_record"}
    clash = [m for m in ("_file", "_block", "_chunk", "_first", "_rows", "_reason") if m in taken]
    if clash:
        raise ValueError(f"columns of these names can't be carried: {clash}")
    places = T.StructType.fromDDL("_file string, _block bigint, _chunk bigint, _first bigint, _rows bigint, _reason string")
    staged = T.StructType([*fields, *places])
    names, arrow, arrow_places = [f.name for f in fields], to_arrow_schema(fields), to_arrow_schema(places)

    own = T.StructType.fromDDL(schema).fieldNames()
    times, zone = [f.name for f in fields if isinstance(f.dataType, T.TimestampType)], spark.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        place, number, rows = None, 0, 0
        # small chunks are handed on together: results, and one row of marks per chunk
        results: list[pa.RecordBatch] = []
        marks: dict[str, list] = {f.name: [] for f in places}

        def ended() -> None:
            nonlocal held, number, rows
            chunk = held[0].reset_index(drop=True) if len(held) == 1 else pd.concat(held, ignore_index=True)
            n, reason = len(chunk), None
            try:
                result = transform(chunk)[names]
                for c in times:  # a time without a zone is the session's
                    at = pd.to_datetime(result[c])
                    result = result.assign(**{c: at.dt.tz_localize(zone, ambiguous=False) if at.dt.tz is None else at})
                results.append(pa.RecordBatch.from_pandas(result, arrow, preserve_index=False))
            except Exception as e:  # whatever the caller's function raises is that chunk's
                reason = f"{type(e).__name__}: {e}"[:500]
            for values, v in zip(marks.values(), (*place, number, number * chunk_rows, n, reason), strict=True):
                values.append(v)
            held, number, rows = [], number + 1, 0

        def handed() -> Iterator[pa.RecordBatch]:
            done = pa.Table.from_batches(results, arrow)
            n, m = done.num_rows, len(marks["_chunk"])
            for field in arrow_places:
                done = done.append_column(field, pa.nulls(n, field.type))
            head = pa.table([*[pa.nulls(m, f.type) for f in arrow], *[pa.array(marks[f.name], f.type) for f in arrow_places]], schema=done.schema)
            results.clear()
            marks.update({c: [] for c in marks})
            yield from pa.concat_tables([head, done]).combine_chunks().to_batches()

        for batch in batches:
            # a batch is cut where another block begins
            found = batch.select(["_file", "_block"]).to_pandas()
            starts = [0, *(i for i in (found != found.shift()).any(axis=1).to_numpy().nonzero()[0].tolist() if i), len(found)]
            frame = batch.select(own).to_pandas(coerce_temporal_nanoseconds=True)
            for c in frame.columns:
                if isinstance(frame[c].dtype, pd.DatetimeTZDtype):
                    frame[c] = frame[c].dt.tz_localize(None)
            for start, end in zip(starts, starts[1:], strict=False):
                if start == end:
                    continue
                if (here := (found["_file"].iat[start], int(found["_block"].iat[start]))) != place:
                    if held:
                        ended()
                    place, number = here, 0
                while start < end:
                    take = frame.iloc[start : min(end, start + chunk_rows - rows)]
                    held.append(take)
                    start, rows = start + len(take), rows + len(take)
                    if rows == chunk_rows:
                        ended()
                if sum(r.num_rows for r in results) + len(marks["_chunk"]) >= 20_000:
                    yield from handed()
        if held:
            ended()
        if marks["_chunk"]:
            yield from handed()

    read = Observation("read")
    raw = spark.read.schema(f"{schema}, _corrupt_record string").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    seen = raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    seen = seen.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))
    table = shared_folder(spark, "chunks")
    seen.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").mapInArrow(run, staged).write.parquet(table)
    done = spark.read.schema(staged).parquet(table)
    done.where("_chunk is null").select(*[F.col(f"`{n}`") for n in names]).write.mode("overwrite").csv(output, header=True)
    marks = done.where("_chunk is not null")
    faults = marks.where("_reason is not null").select("_file", "_block", "_chunk", "_first", "_rows", "_reason").toDF(*[f.name for f in T.StructType.fromDDL(FAULTS)])
    n = marks.agg(F.count(F.lit(1)).alias("chunks"), F.count("_reason").alias("failed"), F.sum(F.when(F.col("_reason").isNotNull(), F.col("_rows"))).alias("lost")).first()
    counts = {"rows_read": read.get["rows"], "rows_malformed": read.get["bad"], "chunks": n["chunks"], "chunks_failed": n["failed"], "rows_failed": n["lost"] or 0}
    return counts | {"rows_written": done.where("_chunk is null").count()}, faults
