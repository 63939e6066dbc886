"""Sessions of a stream of events: by key, runs of events no further apart than a gap.

Events of a batch are first combined where they were read: those of a key within
one stretch of time as long as the gap belong together, whatever comes later.  So a
hot key sends a row for each such stretch of a task, not for each event.  The open sessions of
a key are its state, one value, since each is asked of the state store by itself; a timer
closes each session once the watermark shows that nothing can join it any more.  What is older than the watermark is dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The least setting of the state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The open sessions of a key in order: four numbers of 64 bits each.
_OPEN = "sessions binary"
_NAMES = ["first", "last", "n", "total"]


def merged(spans: list[list[int]], gap: int) -> list[list[int]]:
    """(first, last, n, total) of spans, joined where no more than ``gap`` lies between them."""
    return _merged(np.array(spans, dtype=np.int64).reshape(-1, 4), gap).tolist()


def _merged(spans: np.ndarray, gap: int) -> np.ndarray:
    if len(spans) < 2:
        return spans
    first, last, n, total = spans[np.argsort(spans[:, 0], kind="stable")].T
    last = np.maximum.accumulate(last)  # what begins a session begins behind all before it
    begin = np.flatnonzero(np.append(True, first[1:] - last[:-1] > gap))
    return np.column_stack([first[begin], last[np.append(begin[1:], len(first)) - 1], np.add.reduceat(n, begin), np.add.reduceat(total, begin)])


def _combined(gap: int):
    """Rows (key, t, value) of a batch -> a row for each key and stretch of ``gap`` microseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            stretch = pa.array(t.to_numpy() // max(gap, 1))
            table = pa.table({"key": batch.column("key"), "stretch": stretch, "t": t, "value": batch.column("value")})
            found = table.group_by(["key", "stretch"]).aggregate([("t", "min"), ("t", "max"), ("t", "count"), ("value", "sum")])
            found = found.select(["key", "t_min", "t_max", "t_count", "value_sum"])
            yield from found.rename_columns(["key", "first", "last", "n", "total"]).to_batches()

    return run


class Sessions(StatefulProcessor):
    """Keeps the open sessions of a key; emits (key, first, last, n, total) of those that the watermark has closed."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _sessions(self) -> np.ndarray:
        kept = self.open.get()
        return np.frombuffer(kept[0] if kept else b"", dtype=np.int64).reshape(-1, 4)

    def _keep(self, sessions: np.ndarray) -> None:
        """Keep the open sessions of the key, with a timer at which the first of them may close."""
        if len(sessions):
            self.open.update((sessions.tobytes(),))
            self.handle.registerTimer((int(sessions[:, 1].min()) + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [frame[_NAMES].to_numpy(np.int64) for frame in rows]
        self._keep(_merged(np.concatenate([self._sessions(), *spans]), self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = self._sessions()
        closed = sessions[:, 1] + self.gap < now
        self._keep(sessions[~closed])
        if closed.any():  # else the session that the timer was for has grown meanwhile
            found = pd.DataFrame(sessions[closed], columns=_NAMES)
            found.insert(0, "key", key[0])
            yield found

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str, time: str, value: str, gap_seconds: int, late_seconds: int) -> DataFrame:
    """A stream of (key, first, last, n, total): sessions that are closed, in append mode.

    ``time`` is a timestamp; the watermark is ``late_seconds`` behind the greatest.  A
    session closes when no event that isn't late could still join it.  total is the
    sum of ``value``, whole numbers, nulls left out; null keys and times are left
    out.  The session must have STATE_STORE as its state store.
    """
    gap = gap_seconds * 1_000_000
    kind = dict(events.dtypes)[key]
    t = F.unix_micros(F.col(time))
    rows = events.select(F.col(key).alias("key"), t.alias("t"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("value"))
    rows = rows.where("key IS NOT NULL AND t IS NOT NULL")
    rows = rows.mapInArrow(_combined(gap), f"key {kind}, first long, last long, n long, total long")
    rows = rows.withColumn("at", F.timestamp_micros("last")).withWatermark("at", f"{late_seconds} seconds")
    return rows.groupBy("key").transformWithStateInPandas(
        Sessions(gap), outputStructType=f"key {kind}, first long, last long, n long, total long", outputMode="append", timeMode="EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query of ``sessions`` has dropped as older than the watermark; a combined stretch counts as one."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
