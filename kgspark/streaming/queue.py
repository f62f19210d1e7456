"""Work on changed keys with a quiet time, retries and a sequence guard, kept in keyed state with timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kgspark.streaming.windows import backoff

OUT = "seq long, kind string, attempt int, at_ms long, outcome string"
PENDING = "seq long, kind string, attempt int, due_ms long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside may keep state with timers, which needs the RocksDB store."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def lasting(error: Exception) -> bool:
    """Whether trying again is no use: anything but a failing connection or a time-out."""
    return not isinstance(error, (ConnectionError, TimeoutError))


@dataclass(frozen=True)
class Retries:
    """Waits in milliseconds: before a change is worked on, and before a failed one is tried again (doubling up to the cap)."""

    quiet_ms: int = 2_000
    base_ms: int = 2_000
    cap_ms: int = 30_000
    most: int = 3

    def wait(self, failures: int) -> int | None:
        seconds = backoff(failures, self.base_ms / 1000, self.cap_ms / 1000, self.most)
        return None if seconds is None else round(seconds * 1000)


class ChangeQueue(StatefulProcessor):
    """The state of a key is its newest sequence number and at most one pending change, so it never grows.

    In event time a key's rows are taken in their order, and what was due before a row is worked on ahead of it; so the
    outcome doesn't depend on how rows fall into batches. Otherwise waits run from the moment a row comes.
    """

    def __init__(self, work: Callable[[Any, int, str, int], None], deleted: str, retries: Retries, lasting: Callable[[Exception], bool], event_time: bool, forget_ms: int | None):
        self.work, self.deleted, self.retries, self.lasting, self.event_time, self.forget_ms = work, deleted, retries, lasting, event_time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long", self.forget_ms)
        self.pending = handle.getValueState("pending", PENDING)

    def _advance(self, key: tuple, pending: tuple | None, until: int, out: list[tuple]) -> tuple | None:
        """Try what is due by ``until``, as often as it falls due; what is pending then."""
        while pending is not None and pending[3] <= until:
            seq, kind, attempt, due = pending
            attempt += 1
            try:
                self.work(key[0], seq, kind, attempt)
                outcome, wait = "done", None
            except Exception as e:  # the outcome says so
                wait = None if self.lasting(e) else self.retries.wait(attempt)
                outcome = "failed" if self.lasting(e) else "retry" if wait is not None else "exhausted"
            out.append((*key, seq, kind, attempt, due, outcome))
            pending = None if wait is None else (seq, kind, attempt, due + wait)
        return pending

    def _keep(self, before: tuple | None, pending: tuple | None) -> None:
        """Store what is pending, with its timer."""
        if pending == before:
            return
        if before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if pending is None:
            self.pending.clear()
        else:
            self.pending.update(pending)
            self.handle.registerTimer(pending[3])

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", *(c.split()[0] for c in OUT.split(", "))])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        changes = pd.concat(list(rows)).sort_values(["at_ms", "seq"] if self.event_time else "seq")
        now = timerValues.getCurrentProcessingTimeInMs()
        newest = self.seen.get()[0] if self.seen.exists() else None
        before = pending = tuple(self.pending.get()) if self.pending.exists() else None
        for seq, kind, at in zip(changes["seq"].tolist(), changes["kind"].tolist(), changes["at_ms"].tolist()):
            at = at if self.event_time else now
            pending = self._advance(key, pending, at, out)
            if newest is not None and seq <= newest:
                continue  # older than what the key has seen
            newest = seq
            if kind == self.deleted:
                pending = None
                out.append((*key, seq, kind, 0, at, "deleted"))
            else:
                pending = (seq, kind, 0, at + self.retries.quiet_ms)
        self.seen.update((newest,))
        self._keep(before, pending)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        before = tuple(self.pending.get()) if self.pending.exists() else None
        until = expiredTimerInfo.getExpiryTimeInMs()
        if self.event_time:
            until = max(until, timerValues.getCurrentWatermarkInMs())
        self._keep(before, self._advance(key, before, until, out))
        yield from self._frame(out)

    def close(self) -> None:
        pass


def worked(changes: DataFrame, work: Callable[[Any, int, str, int], None], key: str, deleted: str = "delete", retries: Retries = Retries(), lasting: Callable[[Exception], bool] = lasting,
           late: str | None = "10 minutes", forget_ms: int | None = None, seq: str = "seq", kind: str = "kind", time: str = "ts") -> DataFrame:
    """(key, seq, kind, attempt, at_ms, outcome): every try of ``work(key, seq, kind, attempt)`` on a key's newest change.

    A change waits until its key has been quiet; a newer one takes its place, with tries counted anew, whether it
    waits for its first try or another. A try that raises is repeated after doubling waits unless the error is
    ``lasting``; outcomes: done, retry, exhausted, failed. A change of kind ``deleted`` goes ahead at once (outcome
    deleted) and drops what is pending. Changes older than the key's newest are ignored. With ``late`` all of this
    happens in event time, else in processing time, where ``forget_ms`` bounds how long idle keys are remembered; such a
    query waits for its timers and never runs out of work, so don't drain it. Start the query inside ``timed_state``.
    """
    event_time = late is not None
    if event_time and forget_ms is not None:
        raise ValueError("forget_ms needs processing time")
    rows = changes.withWatermark(time, late) if event_time else changes
    rows = rows.selectExpr(f"{key} AS key", f"{seq} AS seq", f"{kind} AS kind", f"unix_millis({time}) AS at_ms", time)
    queue = ChangeQueue(work, deleted, retries, lasting, event_time, forget_ms)
    of = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(queue, f"key {of}, {OUT}", "append", "EventTime" if event_time else "ProcessingTime")
