"""Stateful processors with timers of their own: leases, sessions and stores
that forget (T2, T5).

They keep their state in RocksDB, so a key's history is bounded by the
executor's disk and not by its memory. Event-time timers fire when the watermark
passes them; a state with a time to live is dropped by the state store itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def unfinished(spark: SparkSession, more: bool = True) -> Iterator[None]:
    """With ``more`` to come, queries started inside do not close with a batch
    without data: timers wait for the next run from the same checkpoint."""
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false" if more else before)
    try:
        yield
    finally:
        spark.conf.set(NO_DATA, before)


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us, UTC]" if ts.dt.tz is not None else "datetime64[us]").astype("int64")


def _timer(micros: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-micros // 1000)


class Leases(StatefulProcessor):
    """A lease on a key. The first event takes it, every later one renews
    it, and the event ``done`` gives it back; one that is not renewed in time
    expires, by the next event if that comes first, else by a timer."""

    def __init__(self, micros: int, done: str) -> None:
        self.micros, self.done = micros, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "attempts int, since long, until long, beats int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, out = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        # One read and one write of the state for all events of a key; ``beats``
        # of zero say that no lease is open.
        attempts, since, until, beats = self.held.get() or (0, 0, 0, 0)
        if beats:
            self.handle.deleteTimer(_timer(until))
        for at, kind in zip(_micros(events["ts"]).tolist(), events["event_type"].tolist(), strict=True):
            if beats and until <= at:
                out.append((key[0], attempts, "expired", since, until, beats))
                beats = 0
            if not beats:
                attempts, since, until, beats = attempts + 1, at, at + self.micros, 1
            else:
                until, beats = max(until, at + self.micros), beats + 1
            if kind == self.done:
                out.append((key[0], attempts, "done", since, until, beats))
                beats = 0
        self.held.update((attempts, since, until, beats))
        if beats:
            self.handle.registerTimer(_timer(until))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "attempt", "state", "since", "until", "beats"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, since, until, beats = self.held.get() or (0, 0, 0, 0)
        if beats and until <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((attempts, since, until, 0))
            yield pd.DataFrame([(key[0], attempts, "expired", since, until, beats)], columns=["user_id", "attempt", "state", "since", "until", "beats"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, seconds: int, done: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, attempt, state, since, until, beats) of every lease that has
    ended; times are microseconds. Events of a key are folded in time."""
    out = "user_id long, attempt int, state string, since long, until long, beats int"
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Leases(seconds * 1_000_000, done), out, "append", "eventTime")


class Sessions(StatefulProcessor):
    """T5: a session holds the last ``most`` events of a key and ends ``micros``
    after the latest one. Rows may come in any order; those behind the watermark
    never reach it."""

    def __init__(self, micros: int, most: int) -> None:
        self.micros, self.most = micros, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, first long, last long, ats array<long>, ids array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, first, last, ats, ids = self.held.get() or (0, None, None, [], [])
        if n:
            self.handle.deleteTimer(_timer(last + self.micros))
        kept = list(zip(ats, ids, strict=True))
        for pdf in rows:
            at = _micros(pdf["ts"])
            kept = sorted([*kept, *zip(at.tolist(), pdf["event_id"].tolist(), strict=True)])[-self.most :]
            n, first, last = n + len(pdf), int(at.min()) if first is None else min(first, int(at.min())), int(at.max()) if last is None else max(last, int(at.max()))
        self.held.update((n, first, last, [t for t, _ in kept], [i for _, i in kept]))
        self.handle.registerTimer(_timer(last + self.micros))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, first, last, _, ids = self.held.get()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first": [first], "last": [last], "recent": [list(ids)]})
        self.held.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, seconds: int, most: int = 10, late: str = "10 minutes") -> DataFrame:
    """(user_id, n, first, last, recent) of every session that has ended."""
    out = "user_id long, n long, first long, last long, recent array<long>"
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Sessions(seconds * 1_000_000, most), out, "append", "eventTime")


class Forgetting(StatefulProcessor):
    """T5: the latest value of a key, which the state store drops once it is
    older than its time to live (by the clock)."""

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string, n long", self.millis)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.value.get()[1] if self.value.exists() else 0
        for pdf in rows:
            value, n = pdf.sort_values("seq")["value"].iloc[-1], n + len(pdf)
        self.value.update((value, n))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "n": [n]})

    def close(self) -> None:
        pass


def forgetting(rows: DataFrame, millis: int) -> DataFrame:
    """(key, value, n) after every batch of (key, seq, value): n counts the rows
    of a key since it was last forgotten. As the clock may always have more to
    forget, such a stream never runs dry: stop it, it does not end by itself."""
    return rows.groupBy("key").transformWithStateInPandas(Forgetting(millis), "key string, value string, n long", "update", "processingTime")
