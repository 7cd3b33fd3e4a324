"""Raw segment files as a data source that opens only the files it is asked for (S1, S4, F6): `segment_files`.

A file's segment and day are in its name, so filters on `segment_name` and `file_date` choose files before any is opened: a month out of a
history of years costs a listing and that month.  A partition is some files of together about `partition_bytes`, read one by one in their task; rows
are those of `readers.parse_segments`.

Listing is one call of the file system per folder, on the driver, of names and sizes only, as Spark's own index of files is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from eodlake import specs
from eodlake.sources import readers
from eodlake.sources.named import opened, qualified

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_PYTHON = {"yyyyMMdd": "%Y%m%d", "ddMMyy": "%d%m%y", "ddMMyyyy": "%d%m%Y"}
_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
}


@dataclass
class Files(InputPartition):
    places: tuple[tuple[str, str, date], ...]  # path, name, day


def day_of(name: str, spec: specs.SegmentSpec) -> date | None:
    found = readers.re.search(spec.raw_name, name)
    try:
        return datetime.strptime(found[1], _PYTHON[spec.date_format]).date() if found else None
    except ValueError:
        return None


class SegmentReader(DataSourceReader):
    def __init__(self, uri: str, columns: dict[str, list[str]], rows: T.StructType, partition_bytes: int) -> None:
        self.uri, self.columns, self.rows, self.partition_bytes = uri, columns, rows, partition_bytes
        self.chosen = [specs.SEGMENTS[c] for c in columns]
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those on a file's segment and day choose files; Spark applies the others to rows."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if type(f) in _TESTS and column in ("segment_name", "file_date", "file_name"):
                self.tests.append((column, f))
            else:
                yield f

    def _asked(self, **own: object) -> bool:
        # a name without a good date has a null day, which no filter accepts
        return all(own[c] is not None and _TESTS[type(f)](own[c], f.value) for c, f in self.tests)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = opened(self.uri)
        found, held, size = [], [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            spec = next((s for s in self.chosen if readers.re.search(s.raw_name, info.base_name)), None) if info.is_file else None
            if spec is None or not self._asked(segment_name=spec.name, file_date=(day := day_of(info.base_name, spec)), file_name=info.base_name):
                continue
            if held and size + info.size > self.partition_bytes:
                found.append(Files(tuple(held)))
                held, size = [], 0
            held.append((info.path, info.base_name, day))
            size += info.size
        return [*found, Files(tuple(held))] if held or not found else found

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.uri)
        out, arrow = T.StructType(self.rows.fields[:-1]), to_arrow_schema(self.rows)
        patterns = [(readers.re.compile(s.raw_name), s, set(self.columns[s.name])) for s in self.chosen]
        for path, name, day in partition.places:
            with system.open_input_file(path) as f:
                data = readers.parsed_columns(name, f.read(), patterns, out)
            if data is not None:
                n = len(data["line_no"])
                columns = [*(list(data[c]) for c in out.fieldNames()), [day] * n]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


class SegmentFiles(DataSource):
    """Options: `uri`, the folder; `columns`, each segment's own as JSON; `rows`, the schema as JSON; `partition_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "segment_files"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["rows"]))

    def reader(self, schema: T.StructType) -> SegmentReader:
        return SegmentReader(self.options["uri"], json.loads(self.options["columns"]), self.schema(), int(self.options["partition_bytes"]))


def read_segments(spark: SparkSession, path: str, segments: list[str], partition_bytes: int = 64 << 20) -> DataFrame:
    """Files of these segments below `path`, as `readers.parse_segments` gives them; filters on segment_name, file_date and file_name choose the files that
    are opened.  Unknown segments are ignored."""
    spark.dataSource.register(SegmentFiles)
    spark.conf.set(PUSHDOWN, "true")  # read when a filter is planned
    chosen = [specs.SEGMENTS[s] for s in dict.fromkeys(segments) if s in specs.SEGMENTS]
    columns = {s.name: sorted(own) for _, s, own in readers.name_patterns(chosen)}
    rows = T.StructType([*readers.segment_schema(chosen), T.StructField("file_date", T.DateType())])
    options = {"uri": qualified(spark, path), "columns": json.dumps(columns), "rows": rows.json(), "partition_bytes": str(partition_bytes)}
    return spark.read.format("segment_files").options(**options).load()
