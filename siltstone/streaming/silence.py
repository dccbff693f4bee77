"""Debounce by silence on a live stream: what changed is handed on once nothing has for a while.

Each key (a project, a tree, a user) has a burst in Spark's state: its first and last event, their
number, and its paths, a row each, so a burst may be of any size.  Every event puts off the burst's
timer by the gap; when the timer goes off the burst is handed on and forgotten.  With event time
the watermark drives the timers, so a replayed log gives the bursts that :func:`.watch.debounce`
gives for the same log; with processing time the clock does, as a watcher of files needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.deploy import ship

#: The state store that keeps rows of lists and timers beside values; set it in the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Burst(StatefulProcessor):
    """One key's burst; times are whole microseconds."""

    def __init__(self, gap_us: int, by_clock: bool, key: str) -> None:
        self.gap, self.by_clock, self.key = gap_us, by_clock, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "start long, last long, n long")
        self.paths = handle.getMapState("paths", "path string", "n long")

    def _close(self, key: tuple) -> pd.DataFrame:
        start, last, n = self.span.get()
        found = sorted(k[0] for k in self.paths.keys())
        self.span.clear()
        self.paths.clear()
        return pd.DataFrame({self.key: [key[0]], "start_us": [start], "end_us": [last + self.gap], "paths": [found], "n": [n]})

    def _put_off(self, until_us: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-until_us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, path in sorted(zip(part["us"].tolist(), part["path"].tolist(), strict=True)):
                if self.span.exists():
                    start, last, n = self.span.get()
                    if at >= last + self.gap:  # the silence lay within what came together
                        yield self._close(key)
                        start, last, n = at, at, 0
                else:
                    start, last, n = at, at, 0
                self.span.update((min(start, at), max(last, at), n + 1))
                if path is not None:
                    seen = self.paths.getValue((path,))
                    self.paths.updateValue((path,), ((seen[0] if seen else 0) + 1,))
        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.by_clock else self.span.get()[1]
        self._put_off(now + self.gap)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            yield self._close(key)

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, gap: timedelta, key: str, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """(key, start_us, end_us, paths, n) of each burst of the streaming ``events`` (key, ts, path).

    A burst ends after ``gap`` without an event of its key; ``late``: how much later than others of
    its key an event may come (event time only).  Null keys are a key of their own; null paths are
    counted and not listed.  The session needs the state store of :data:`STORE`.
    """
    from pyspark.sql import functions as F

    ship(events.sparkSession)
    timed = events if by_clock else events.withWatermark("ts", late)
    rows = timed.select(F.col(key), F.col("ts"), F.unix_micros("ts").alias("us"), F.col("path"))
    kind = rows.schema[key].dataType.simpleString()
    processor = Burst(int(gap.total_seconds() * 1_000_000), by_clock, key)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"`{key}` {kind}, start_us long, end_us long, paths array<string>, n long",
        outputMode="append", timeMode="ProcessingTime" if by_clock else "EventTime",
    )
