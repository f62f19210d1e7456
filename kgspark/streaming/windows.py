"""Event-time windows and change feeds on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A growing folder (or file) of parquet as a stream; the schema comes from what is there, as a timestamp without surprises."""
    schema = spark.read.parquet(path).schema
    # a pattern, since the stream source takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is available now into an exactly-once parquet sink of the shared folder, and read the result."""
    spark, root = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start(f"{root}-rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}-rows")


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run what is available now through ``each`` (batch, id), which must be idempotent by id."""
    root = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling (or sliding) windows; rows later than ``late`` are dropped, closed windows are emitted once."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    rows = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def debounced(changes: DataFrame, keys: list[str], quiet: str = "2 seconds", late: str = "10 minutes", time: str = "ts", order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """One row a burst of changes of a key, once it has been quiet: its last change counts."""
    rows = changes.withWatermark(time, late).groupBy(F.session_window(time, quiet).alias("w"), *keys)
    rows = rows.agg(F.count("*").alias("changes"), F.max_by(kind, F.struct(time, order)).alias("last"), F.max(time).alias("at"))
    return rows.select(*keys, F.col("w.start").alias("start"), "changes", "last", "at")


def latest_changes(changes: DataFrame, key: str, order: str = "event_id", kind: str = "event_type") -> DataFrame:
    """(key, seq, kind): emits a key's newest change; one that is older than what the key has seen is dropped.

    A key's state is one number and never grows.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        newest: tuple[int, str] | None = None
        for b in batches:
            if len(b):
                i = b[order].idxmax()
                if b[order][i] > best:
                    best, newest = int(b[order][i]), (int(b[order][i]), b[kind][i])
        state.update((best,))
        if newest:
            yield pd.DataFrame({"key": [k[0]], "seq": [newest[0]], "kind": [newest[1]]})

    return changes.select(key, order, kind).groupBy(key).applyInPandasWithState(run, "key long, seq long, kind string", "seq long", "update", "NoTimeout")


def backoff(attempt: int, base_seconds: float = 2.0, cap_seconds: float = 30.0, most: int = 3) -> float | None:
    """Wait before a failed change is tried again: doubling, capped; None when it has been tried often enough."""
    return None if attempt > most else min(base_seconds * 2 ** (attempt - 1), cap_seconds)


def with_retries(step: Callable[[], None], retryable: Callable[[Exception], bool], sleep: Callable[[float], None], **options) -> int:
    """Run a batch's step until it works; the number of tries. What can't be retried, or not again, is raised."""
    attempt = 0
    while True:
        attempt += 1
        try:
            step()
            return attempt
        except Exception as e:
            wait = backoff(attempt, **options)
            if wait is None or not retryable(e):
                raise
            sleep(wait)


def apply_changes(log) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps ``log`` (a ChangeLog): a batch adds its own rows under its id, and a replay repeats itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, batch_id)

    return each
