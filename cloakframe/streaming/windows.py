"""Windows and joins on streams: sessions, sliding windows, two streams within a time span, and the state of jobs with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Event times without a zone count as times of the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """by, begin, end, n: rows of a group with less than `gap` between them; a session ends with its last row plus the gap.

    A session comes out when the watermark has passed its end; rows later than that are left out.
    """
    return _timed(stream, time, late).groupBy(*by, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def sliding(stream: DataFrame, time: str, by: list[str], length: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """by, begin, end, n: counts in windows of a length that begin every `slide`, so that a row is in several."""
    return _timed(stream, time, late).groupBy(*by, F.window(time, length, slide)).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n")


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, span: str, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of two streams with one key, the right one at the left one's time or up to `span` later.

    how: inner, or leftOuter, where a left row without a match comes out once the watermark says that none can come.
    Columns of the right stream but the key and its time must have names of their own. State is as long as span and lateness.
    """
    a = _timed(left, left_time, late)
    b = _timed(right, right_time, late).withColumnRenamed(key, "__key")
    on = (F.col(key) == F.col("__key")) & (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {span}"))
    return a.join(b, on, how).drop("__key")


JOB = "job_id string, status string, done long, at timestamp"
_ENDS = ("completed", "failed", "stopped")


class _Jobs(StatefulProcessor):
    """The last state of each job; a timer runs from its last sign of life."""

    def __init__(self, patience_ms: int, keep_ms: int):
        self.patience, self.keep = patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, done long, at long", ttlDurationMs=self.keep or None)

    def _row(self, key, status: str, done: int, at: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "done": [done], "at": [pd.Timestamp(at, unit="ms")]})

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, done, at = self.state.get() if self.state.exists() else ("queued", 0, -1)
        events = pd.concat(list(rows)).sort_values(["at", "done"], kind="stable")
        before = (status, done, at)
        for r in events.itertuples(index=False):
            when = int(pd.Timestamp(r.at).timestamp() * 1000)
            if when < at:
                continue  # an older word than the last one
            status, done, at = r.status or status, max(done, int(r.done) if pd.notna(r.done) else 0), when
        if (status, done, at) == before:
            return
        self.state.update((status, done, at))
        self._timer(None if status in _ENDS else at + self.patience)
        yield self._row(key, status, done, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, done, at = self.state.get()
        if status not in (*_ENDS, "interrupted"):
            when = int(expiredTimerInfo.getExpiryTimeInMs())
            self.state.update(("interrupted", done, at))
            yield self._row(key, "interrupted", done, when)

    def close(self) -> None:
        pass


def job_states(stream: DataFrame, patience: int = 900, late: str = "1 minute") -> DataFrame:
    """job_id, status, done, at: each change of a job's state, from rows (job_id, status, done, at) in any order.

    A job that has not ended and gives no sign for `patience` seconds of event time becomes interrupted, by its timer;
    a later sign takes it up again. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = _timed(stream, "at", late).select("job_id", "status", "done", "at")
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(patience * 1000, 0), T._parse_datatype_string(JOB), "Update", "EventTime")
