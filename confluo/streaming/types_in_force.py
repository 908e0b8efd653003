"""As-of join of two streams: each window with the content type in force at its start, changes coming in any order.

Windows wait until the watermark has passed their start: then every change that may still come is later than they are, so a
change that comes late, but within the watermark's delay, corrects all windows that it concerns before they go out. A stream's state is
its waiting windows and its changes by (start, window); of the changes at or before the watermark only the last one is kept, as no
later window can have another. A change of the same start and window replaces the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNKNOWN = "UNKNOWN"
OUT = "stream_id long, window_id long, ms long, content_type string"


class TypesInForce(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", "ms long, window long", "content_type string")
        self.waiting = handle.getMapState("waiting", "ms long, window long", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _next_timer(self, at: int | None) -> None:
        """One timer a stream, at its earliest waiting window."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if at == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.timer.get()[0] if self.timer.exists() else None
        for frame in rows:
            for r in frame.itertuples():
                where = (int(r.ms), int(r.window_id))
                if r.content_type is None:
                    n = self.waiting.getValue(where)[0] if self.waiting.containsKey(where) else 0
                    self.waiting.updateValue(where, (n + 1,))
                    # A window may go when the watermark is past its start.
                    at = where[0] + 1 if at is None else min(at, where[0] + 1)
                else:
                    self.changes.updateValue(where, (r.content_type,))
        self._next_timer(at)
        yield pd.DataFrame([], columns=["stream_id", "window_id", "ms", "content_type"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out, left = timerValues.getCurrentWatermarkInMs(), [], None
        self.timer.clear()
        changes = sorted((where, value[0]) for where, value in self.changes.iterator())
        waiting = sorted((where, value[0]) for where, value in self.waiting.iterator())
        k, kind = 0, UNKNOWN
        for (ms, window), n in waiting:
            if ms >= passed:
                left = ms + 1
                break
            while k < len(changes) and changes[k][0][0] <= ms:
                kind, k = changes[k][1], k + 1
            out += [(int(key[0]), window, ms, kind)] * n
            self.waiting.removeKey((ms, window))
        old = [where for where, _ in changes if where[0] < passed]
        for where in old[:-1]:
            self.changes.removeKey(where)
        self._next_timer(left)
        yield pd.DataFrame(out, columns=["stream_id", "window_id", "ms", "content_type"])

    def close(self) -> None:
        pass


def types_in_force(windows: DataFrame, changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(stream_id, window_id, ms, content_type) of each window (stream_id, window_id, ms) once the watermark is past it. ``changes``:
    (stream_id, change_window, start_ms, content_type). What is later than the delay allows is dropped."""
    at = lambda c: F.timestamp_millis(c).alias("ts")
    a = windows.select("stream_id", "window_id", "ms", F.lit(None).cast("string").alias("content_type"), at("ms"))
    b = changes.where("content_type is not null").select("stream_id", F.col("change_window").alias("window_id"), F.col("start_ms").alias("ms"), "content_type", at("start_ms"))
    both = a.unionByName(b).where("ms is not null").withWatermark("ts", delay)
    return both.groupBy("stream_id").transformWithStateInPandas(TypesInForce(), OUT, "Append", "EventTime")
