"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the corpus operators: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What a task hands to Python at once while a step is written.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, a temporary one is made on a
    single machine (a local master); on a cluster that is an error, as executors would write to their own disks."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-eodlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths written in the innermost `passing`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded by rows and bytes; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and an
    executor that is lost later loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that `cut` has written."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def passing(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of `make` as a written table; the tables that it was made of are deleted then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
        _made.reset(token)
        return cut(df, name)
    finally:
        if _made.get() is made:
            _made.reset(token)
        remove(spark, *made)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that are not among `columns` (upper and lower case count as equal)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, with the memory that it has freed given back to the machine at its end: Python workers live on after their task, next to those of other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]] | dict[str, list]], schema: str, rows: int = 2000
) -> DataFrame:
    """mapInArrow with a function from a record batch of at most `rows` rows to columns by name (or
    several of these)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))
        for out in map(fn, parts):
            for cols in [out] if isinstance(out, dict) else out:
                yield pa.record_batch([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lean(run), schema)


def pack(*columns: np.ndarray | bytes) -> bytes:
    """Columns of any lengths as one compressed value, which shuffles at a fraction of their rows' size."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(columns, 5))


def unpack(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def parted(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the parts that occur."""
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0))) if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)], strict=False):
        yield int(part[order[a]]), order[a:b]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, blobs) of rows (key, blob) that come in the order of their keys."""
    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key and blobs:
                yield key, blobs
                blobs = []
            key = k
            blobs.append(blob)
    if blobs:
        yield key, blobs


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b LONG) as (node, component): the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; the rounds grow with the
    logarithm of a component's diameter.  Every round is one written table; minima are combined before the
    shuffle, and the join back on a hub can be split by adaptive execution.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        # large star: neighbours above a node move to the smallest of its neighbourhood
        sym = both(e)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        # small star: a node and its lower neighbours move to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        e = cut(
            small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s"))
            .select("s.*")
            .where("a <> b")
            .distinct(),
            "links",
        )
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
