"""Keyed state that ends by itself, as event-time streams: registered streams, and breakers.

State of a key is a row; a timer drops it when its time is over, so that the store holds live keys only.  Output doesn't depend on
how rows fall into batches: what a timer would have done before a row's time is done when the row comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ENDED = "key string, started double, ended double, how string"
CHECKED = "key string, id long, open boolean"


class _Timed(StatefulProcessor):
    """One row of state a key, and a timer at its end."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("live", self.state_schema)

    def close(self) -> None:
        pass

    def held(self) -> tuple[Any, ...] | None:
        return self.state.get() if self.state.exists() else None

    def hold(self, row: tuple[Any, ...], until: float) -> None:
        self.drop()
        self.state.update(row)
        self.handle.registerTimer(_millis(until))

    def drop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.state.exists():
            self.state.clear()


def _millis(seconds: float) -> int:
    return int(-(-seconds * 1000 // 1))


class _Registry(_Timed):
    state_schema = "started double"

    def __init__(self, span: float) -> None:
        self.span = span

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """A start begins a stream, or begins it anew; anything else ends it."""
        live = self.held()
        started = live[0] if live else None
        was, out = started, []
        for t, _, kind in sorted(r for pdf in rows for r in zip(pdf["t"], pdf["id"], pdf["kind"], strict=True)):
            if started is not None:
                over = t >= started + self.span
                out.append((key[0], started, started + self.span if over else t, "expired" if over else "replaced" if kind == "start" else kind))
            started = t if kind == "start" else None
        if started is None:
            self.drop()
        elif started != was:
            self.hold((started,), started + self.span)
        yield pd.DataFrame(out, columns=["key", "started", "ended", "how"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        live = self.held()
        self.drop()
        yield pd.DataFrame([(key[0], live[0], live[0] + self.span, "expired")] if live else [], columns=["key", "started", "ended", "how"])


class _Breaker(_Timed):
    state_schema = "until double"

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        live = self.held()
        until = live[0] if live else float("-inf")
        was, out = until, []
        for t, i, trips in sorted(r for pdf in rows for r in zip(pdf["t"], pdf["id"], pdf["trips"], strict=True)):
            out.append((key[0], i, until > t))
            if trips:
                until = max(until, t + self.ttl)
        if until > was:
            self.hold((until,), until)
        yield pd.DataFrame(out, columns=["key", "id", "open"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.drop()
        yield pd.DataFrame([], columns=["key", "id", "open"])


def _keyed(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(_PROVIDER_KEY, None) != PROVIDER:
        raise ValueError(f"timers need {_PROVIDER_KEY}={PROVIDER}")
    # seconds since 1970 as a double, exact for microseconds
    return events.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("t", F.unix_micros("_at") / 1e6).withColumn("_key", F.col(key).cast("string")).where(F.col("_key").isNotNull() & F.col("_at").isNotNull()).withWatermark("_at", late)


def stream_registry(events: DataFrame, key: str, ts: str, order: str, kind: str, *, span: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """(key, started, ended, how) of streams that have ended: how is what ended them (the ``kind`` of the event, such as cancel), replaced by another start, or expired after ``span`` seconds.

    events: key, event time, ``order`` (ties of time), and ``kind``, of which start registers; rows without a key or a time are left
    out.  Rows later than ``late`` are dropped by the watermark.  A batch's rows of one key are sorted in memory.
    """
    rows = _keyed(events, key, ts, late).select("_key", "_at", "t", F.col(order).cast("long").alias("id"), F.col(kind).alias("kind"))
    return rows.groupBy("_key").transformWithStateInPandas(_Registry(span), ENDED, "Append", "EventTime")


def breaker_stream(events: DataFrame, key: str, ts: str, order: str, trips: str, *, ttl: float, late: str = "0 seconds") -> DataFrame:
    """(key, id, open) for each event: whether an earlier trip of its key is younger than ``ttl`` seconds; a key's state goes with its last trip."""
    rows = _keyed(events, key, ts, late).select("_key", "_at", "t", F.col(order).cast("long").alias("id"), F.col(trips).alias("trips"))
    return rows.groupBy("_key").transformWithStateInPandas(_Breaker(ttl), CHECKED, "Append", "EventTime")
