"""Days that wait for their segments (ST2, ST3), with state: a day is given once, when all its segments are there, and forgotten after its time.

`arrivals` recomputes what a batch touches and needs no state; this is the other way, for callers that must act on a day exactly once (publish it, start a
job).  State is one small record per exchange and day: the segments with their numbers of rows, and whether the day was given.  A timer per day ends it, so
state is bounded by the days of one waiting time, whatever comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from eodlake.operators.append import RANKS

STATUS = "exchange string, file_date date, status string, segments string, n_rows bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPLETE, PENDING, EXPIRED = "complete", "pending", "expired"


class WaitingDays(StatefulProcessor):
    """Rows (exchange, file_date, source_segment, n_rows, arrived) -> STATUS: `pending` or, once, `complete` when a day's segments change; `expired` when a
    day's time ends before it was complete.  What comes for a day that was given changes nothing."""

    def __init__(self, wanted: tuple[str, ...], wait_ms: int) -> None:
        self.wanted, self.wait_ms = frozenset(wanted), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segments = handle.getMapState("segments", "segment string", "n_rows bigint")
        self.given = handle.getValueState("given", "given boolean")

    def _row(self, key: tuple, status: str) -> pd.DataFrame:
        held = sorted((k[0], v[0]) for k, v in self.segments.iterator())
        return pd.DataFrame({"exchange": [key[0]], "file_date": [key[1]], "status": [status], "segments": [",".join(s for s, _ in held)], "n_rows": [sum(n for _, n in held)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, int] = {}
        first = None
        for part in rows:
            for segment, n, arrived in zip(part["source_segment"], part["n_rows"], part["arrived"], strict=True):
                came[segment] = max(came.get(segment, 0), int(n))
                first = arrived if first is None else min(first, arrived)
        if not self.given.exists():
            self.given.update((False,))
            self.handle.registerTimer(int(first.timestamp() * 1000) + self.wait_ms)
        elif self.given.get()[0]:
            return
        for segment, n in came.items():
            self.segments.updateValue((segment,), (n,))
        if self.wanted <= {k[0] for k in self.segments.keys()}:
            self.given.update((True,))
            yield self._row(key, COMPLETE)
        else:
            yield self._row(key, PENDING)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.given.get()[0]:
            yield self._row(key, EXPIRED)
        self.segments.clear()
        self.given.clear()

    def close(self) -> None:
        pass


def stream_days(
    spark: SparkSession, arrivals: DataFrame, output: str, checkpoint: str, wanted: tuple[str, ...] = tuple(RANKS), late: str = "1 day", wait_ms: int = 7 * 86_400_000
) -> StreamingQuery:
    """Statuses of days, appended to `output` as they change.  `arrivals`: a stream of (exchange, file_date, source_segment, n_rows, arrived TIMESTAMP), a row per file or
    part of one; `late` is how far arrival times may be out of order.  Runs over all that is there and ends."""
    parts = arrivals.select("exchange", "file_date", "source_segment", F.col("n_rows").cast("bigint").alias("n_rows"), "arrived").withWatermark("arrived", late)
    days = parts.groupBy("exchange", "file_date").transformWithStateInPandas(WaitingDays(wanted, wait_ms), STATUS, "append", "eventTime")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the only store that holds timers and several variables; a query keeps what it was started with
    try:
        return days.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def last_statuses(spark: SparkSession, output: str) -> DataFrame:
    """The last status of each day: the given ones, those that still wait, and those whose time has ended.  A day's segments only grow and its end
    comes last, so the order is in the rows."""
    rank = F.when(F.col("status") == PENDING, 0).otherwise(1)
    last = F.max(F.struct(rank.alias("rank"), F.length("segments").alias("size"), "status", "segments", "n_rows")).alias("s")
    return spark.read.schema(STATUS).parquet(output).groupBy("exchange", "file_date").agg(last).select("exchange", "file_date", "s.status", "s.segments", "s.n_rows")
