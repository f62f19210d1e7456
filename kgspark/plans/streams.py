"""Streaming queries over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgspark.operators.index import ChangeLog
from kgspark.plans.registry import query
from kgspark.session import shared_dir
from kgspark.streaming import queue
from kgspark.streaming import windows as ops

_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _events(spark, d):
    rows = ops.read_stream(spark, f"{d}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _minutes(c: str):
    return (F.unix_micros(c) / 60_000_000).cast("long").alias(c)


_M = lambda c: f"CAST(epoch_us({c}) // 60000000 AS BIGINT)"
_TOTAL = "floor(sum(value) * 1e4 + 0.5) / 1e4"


@query(
    "stream_tumbling",
    f"WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, {_TOTAL} AS total FROM events GROUP BY ALL) SELECT {_M('s')} AS start, event_type, n, total FROM w WHERE s + INTERVAL 1 HOUR <= {_CLOSED}",
)
def stream_tumbling(spark, d):
    rows = ops.drain(ops.windowed(_events(spark, d), ["event_type"], "1 hour"), "tumbling")
    return rows.select(_minutes("start"), "event_type", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


@query(
    "stream_sliding",
    f"WITH e AS (SELECT ts, value, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), w AS (SELECT b - k * INTERVAL 30 MINUTE AS s, value FROM e CROSS JOIN range(2) t(k)), "
    f"g AS (SELECT s, count(*) AS n, {_TOTAL} AS total FROM w GROUP BY s) SELECT {_M('s')} AS start, n, total FROM g WHERE s + INTERVAL 1 HOUR <= {_CLOSED}",
)
def stream_sliding(spark, d):
    rows = ops.drain(ops.windowed(_events(spark, d), [], "1 hour", "30 minutes"), "sliding")
    return rows.select(_minutes("start"), "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


@query(
    "debounce_sessions",
    "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) "
    f"SELECT user_id, count(*) AS changes, arg_max(event_type, (ts, event_id)) AS last, epoch_us(max(ts)) AS at FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}",
)
def debounce_sessions(spark, d):
    rows = ops.drain(ops.debounced(_events(spark, d), ["user_id"], "30 minutes"), "debounce")
    return rows.select("user_id", "changes", "last", F.unix_micros("at").alias("at"))


_NEWEST = "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1"


@query("stream_latest_change", _NEWEST)
def stream_latest_change(spark, d):
    """Newest change of each key, older ones dropped, whatever order they come in."""
    seen: list = []
    ops.drain_batches(ops.latest_changes(_events(spark, d), "user_id"), "latest", lambda b, i: seen.append(_keep(b)), "update")
    out = seen[0]
    for b in seen[1:]:
        out = out.unionByName(b)
    return out.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))


def _keep(batch):
    from kgspark.session import stage

    return stage(batch, "latest-rows")


@query("stream_index", f"SELECT key, seq, kind FROM ({_NEWEST}) WHERE kind <> 'error'")
def stream_index(spark, d):
    """The index kept by the change stream: an ``error`` event stands for a delete."""
    log = ChangeLog(spark, f"{shared_dir(spark)}/stream-index-{uuid.uuid4().hex}", "key", "seq")
    ops.drain_batches(ops.latest_changes(_events(spark, d), "user_id"), "index", ops.apply_changes(log), "update")
    return log.rows().where("kind <> 'error'").select("key", "seq", "kind")


#: Waits of the registered query, in hours: long against the gaps between events, so that many changes are overtaken.
_QUIET, _BASE, _CAP = 2, 2, 6


def _work(key: int, seq: int, kind: str, attempt: int) -> None:
    """A fixed rule of failure for want of a service: some changes fail at first, some for good."""
    if seq % 17 == 0:
        raise ValueError("can't be worked on")
    if attempt <= seq % 6:
        raise ConnectionError("not there yet")


def _tries() -> str:
    """SQL rows (n, after): the n-th try and its hours after the change."""
    waits = [_QUIET, *(min(_BASE * 2**k, _CAP) for k in range(3))]
    return "(VALUES " + ", ".join(f"({n + 1}, {sum(waits[: n + 1])})" for n in range(4)) + ") t(n, after)"


@query(
    "stream_retries",
    f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS next, (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000 AS upto FROM events),
    tries AS (SELECT *, ms + after * 3600000 AS due FROM e CROSS JOIN {_tries()} WHERE event_type <> 'error' AND (n = 1 OR (event_id % 17 <> 0 AND n - 1 <= event_id % 6)))
    SELECT user_id AS key, event_id AS seq, n AS attempt, due AS at_ms, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN n > event_id % 6 THEN 'done' WHEN n = 4 THEN 'exhausted' ELSE 'retry' END AS outcome FROM tries WHERE due <= coalesce(next, upto)
    UNION ALL SELECT user_id, event_id, 0, ms, 'deleted' FROM e WHERE event_type = 'error'""",
)
def stream_retries(spark, d):
    """Work on the newest change of each key once it has been quiet, with retries; an ``error`` event stands for a delete."""
    hour = 3_600_000
    rows = _events(spark, d).withColumnsRenamed({"event_id": "seq", "event_type": "kind"})
    with queue.timed_state(spark):
        found = ops.drain(queue.worked(rows, _work, "user_id", "error", queue.Retries(_QUIET * hour, _BASE * hour, _CAP * hour)), "retries")
    return found.select("key", "seq", "attempt", "at_ms", "outcome")
