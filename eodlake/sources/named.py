"""Files under exact names, written by tasks (K1, K3): the data source `named_files`.

Rows are (file_name, line), or (file_name, content) with bytes, one row per file.  All lines of a file come to one task, one after the other, in their order.  A task streams each file to a staging folder
of its job; only when all tasks have ended are the files moved to their names, so a job that fails leaves what was there before, a task that runs
twice counts once, and writers at the same time don't meet.  Names don't depend on how Spark cuts its own files.

Files are written through the file system that the path's scheme names, by `pyarrow.fs` (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging-"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's own default names it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file:///") else found


def opened(uri: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (place in the staging folder, name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, header: str | None) -> None:
        self.uri, self.header, self.staging = uri, header, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.uri)
        own, done, name, out = f"{base}/{self.staging}/{uuid.uuid4().hex}", Written(), None, None
        system.create_dir(own, recursive=True)
        seen: set[str] = set()
        try:
            for batch in iterator:
                text = not pa.types.is_binary(batch.column(1).type)
                runs, at = pc.run_end_encode(batch.column(0)), 0
                for here, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if out is None or here != name:
                        if out is not None:
                            out.close()
                        name = here
                        if not name or "/" in name or name.startswith((".", "_")) or name in seen:
                            raise ValueError(f"not a file's name, or its lines don't stand together: {name!r}")
                        seen.add(name)
                        place = f"{own}/{len(done.files)}"
                        out = system.open_output_stream(place, buffer_size=1 << 20)
                        done.files.append((place, name))
                        if self.header is not None:
                            out.write(f"{self.header}\n".encode())
                    lines = batch.column(1).slice(at, end - at)
                    out.write(("\n".join(lines.to_pylist()) + "\n").encode() if text else b"".join(lines.to_pylist()))
                    at = end
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """All tasks have ended: the files get their names.  A move that fails is an error, and its file stays in the staging folder."""
        system, base = opened(self.uri)
        moves = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a file's lines came to several tasks")

        def move(pair: tuple[str, str]) -> None:
            place, target = pair[0], f"{base}/{pair[1]}"
            try:
                system.move(place, target)
            except OSError:
                # some stores don't move onto a file that exists: the old one steps aside until the new one has its name
                aside = f"{base}/{self.staging}/old-{uuid.uuid4().hex}"
                system.move(target, aside)
                try:
                    system.move(place, target)
                except OSError:
                    system.move(aside, target)
                    raise

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))
        if moves:
            system.delete_dir(f"{base}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.uri)
        if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


class NamedFiles(DataSource):
    """Options: `uri`, the folder; `header`, a first line of each file."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, line string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["uri"], self.options.get("header"))


def write_named(lines: DataFrame, path: str, order: list[str], header: str | None = None) -> None:
    """`lines` (file_name, line and the columns of `order`) as files below `path`; a file of a name that is there already is replaced.

    One shuffle, to the file; a task writes one file after the other and holds a batch of lines."""
    spark = lines.sparkSession
    spark.dataSource.register(NamedFiles)
    dealt = lines.repartition("file_name").sortWithinPartitions("file_name", *order).select("file_name", "line")
    out = dealt.write.format("named_files").mode("append").option("uri", qualified(spark, path))
    (out if header is None else out.option("header", header)).save()


def write_contents(files: DataFrame, path: str) -> None:
    """`files` (file_name, content BINARY), each once, as files below `path`; no shuffle."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("file_name", "content").write.format("named_files").mode("append").option("uri", qualified(spark, path)).save()
