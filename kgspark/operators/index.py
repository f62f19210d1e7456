"""The index: manifests, incremental maintenance as versioned snapshots, coverage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions.chunks import chunk_texts
from kgspark.session import known_path, stage


def embed_texts(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, dims: int = 32, column: str = "embedding_text") -> DataFrame:
    """Add ``embedding`` (array of float) by batches. The default hashes words to signs: deterministic, for tests and dry runs."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    make = embedder or hashed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=list(make(b[column].tolist()))) if len(b) else b.assign(embedding=[])

    schema = ", ".join(f"`{n}` {k}" for n, k in chunks.dtypes) + ", embedding array<float>"
    return chunks.mapInPandas(run, schema)


def changed_files(expected: DataFrame, stored: DataFrame, file: str = "path", model: str = "model") -> DataFrame:
    """(file, state) with state ``new``, ``changed`` or ``same``: a file is the same only if both manifests have the same chunks, hashes and model."""
    e = expected.select(file, F.col("block_id"), F.col("content_hash").alias("_h"), F.col(model).alias("_m"))
    s = stored.select(file, F.col("block_id"), F.col("content_hash").alias("_sh"), F.col(model).alias("_sm"))
    both = e.join(s, [file, "block_id"], "full_outer")
    same = F.coalesce((F.col("_h") == F.col("_sh")) & (F.col("_m") == F.col("_sm")), F.lit(False))
    rows = both.groupBy(file).agg(F.bool_and(same).alias("_same"), F.count("_sh").alias("_s"), F.count("_h").alias("_e")).where("_e > 0")
    return rows.select(file, F.when(F.col("_same"), "same").when(F.col("_s") == 0, "new").otherwise("changed").alias("state"))


def stale_files(stored: DataFrame, current: DataFrame, file: str = "path") -> DataFrame:
    return stored.select(file).distinct().join(current.select(file), file, "left_anti")


def merge(stored: DataFrame, fresh: DataFrame, gone: DataFrame, file: str = "path") -> DataFrame:
    """The next snapshot: stored rows of untouched files and all fresh rows."""
    touched = fresh.select(file).distinct().unionByName(gone.select(file).distinct()).distinct()
    return stored.join(touched, file, "left_anti").unionByName(fresh)


class SnapshotStore:
    """Numbered versions of a table in one folder, and a small pointer that is written last: readers see whole versions only."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        """Number of the newest version; None only where nothing was ever published."""
        pointer = known_path(lambda: self.spark.read.schema("version long").json(f"{self.root}/_pointer"))
        return None if pointer is None else pointer.agg(F.max("version")).first()[0]

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.root}/v{version}")

    def publish(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as ``version`` (the next one by default). One that is published already is left as it is."""
        newest = self.current()
        version = (0 if newest is None else newest + 1) if version is None else version
        if newest is None or version > newest:
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}")
            line = self.spark.createDataFrame([(version,)], "version long")
            line.coalesce(1).write.mode("append").json(f"{self.root}/_pointer")
        return version

    def clear(self) -> int | None:
        """Publish an empty version with the same columns."""
        now = self.read()
        return None if now is None else self.publish(now.limit(0))


class ChangeLog:
    """The newest row a key of a stream of changes: each batch adds its own rows, and reading takes the newest of each key.

    A batch costs what it holds, not what the index holds; a replayed batch overwrites itself. ``compact`` folds all
    batches into one snapshot now and then.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: str) -> None:
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        self.base = SnapshotStore(spark, f"{self.root}/base")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")

    def rows(self) -> DataFrame | None:
        """Newest change of each key, deletes included."""
        upto, base = self.base.current(), self.base.read()
        changes = known_path(lambda: self.spark.read.parquet(f"{self.root}/changes"))
        if changes is not None:
            changes = changes.where(F.col("batch") > (-1 if upto is None else upto)).drop("batch")
        all_ = changes if base is None else base if changes is None else base.unionByName(changes)
        if all_ is None:
            return None
        rest = [c for c in all_.columns if c != self.key]
        return all_.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(self.key, "_r.*")

    def compact(self) -> int | None:
        changes = known_path(lambda: self.spark.read.parquet(f"{self.root}/changes"))
        newest = None if changes is None else changes.agg(F.max("batch")).first()[0]
        return None if newest is None else self.base.publish(self.rows(), int(newest))


def checked_blocks(rows: DataFrame, file: str = "path") -> DataFrame:
    """``rows``, which must have one row a (file, block) and a vector in each: the write fails otherwise."""
    n = F.count(F.lit(1)).over(Window.partitionBy(file, "block_id"))
    wrong = F.when(F.size("embedding") < 1, F.lit("empty vector")).when(n > 1, F.lit("block twice"))
    message = F.concat(wrong, F.lit(" in "), F.col(file).cast("string"), F.lit(" "), F.col("block_id"))
    return rows.withColumn("block_id", F.when(wrong.isNotNull(), F.raise_error(message)).otherwise(F.col("block_id")))


def build_index(docs: DataFrame, store: SnapshotStore, key: str = "path", column: str = "text", model: str = "default", embedder=None, max_bytes: int = 2048) -> DataFrame:
    """Bring ``store`` up to date with ``docs`` and return (key, state, chunks): ``same``, ``new``, ``changed`` or ``gone``.

    Texts are chunked, the chunks' hashes compared with the stored ones, and only chunks of files that differ embedded;
    files that are no longer there leave. Published as one version, or not at all. Texts without chunks are no files.
    """
    expected = stage(chunk_texts(docs, key, column, max_bytes).withColumn("model", F.lit(model)), "index-expected")
    stored = store.read()
    none = expected.limit(0).withColumn("embedding", F.array().cast("array<float>"))
    stored = none if stored is None else stored
    states = stage(changed_files(expected, stored, key), "index-states")
    gone = stale_files(stored, expected, key)
    todo = states.where("state <> 'same'").select(key)
    fresh = embed_texts(expected.join(todo, key, "left_semi"), embedder)
    known = stored.groupBy(key).agg(F.count("*").alias("chunks"))
    left = stage(gone.join(known, key).select(key, F.lit("gone").alias("state"), "chunks"), "index-gone")
    if todo.limit(1).count() or left.limit(1).count():
        store.publish(merge(stored, checked_blocks(fresh, key), left, key))
    return states.join(expected.groupBy(key).agg(F.count("*").alias("chunks")), key).unionByName(left)


def index_stats(stored: DataFrame, file: str = "path") -> DataFrame:
    return stored.agg(F.count("*").alias("chunks"), F.count_distinct(file).alias("files"), F.max("updated_at").alias("last_updated"))


def percent(part: Column, whole: Column) -> Column:
    """Two places; never 0 for some, never 100 for less or more than all."""
    p = F.floor(part * 10000.0 / whole + 0.5) / 100
    return (
        F.when(whole <= 0, F.lit(0.0)).when(part <= 0, F.lit(0.0)).when(part == whole, F.lit(100.0))
        .when(part < whole, F.least(F.greatest(p, F.lit(0.01)), F.lit(99.99))).otherwise(F.greatest(p, F.lit(100.01)))
    )


def coverage(indexed: DataFrame, current: DataFrame, group: list[str], file: str = "path") -> DataFrame:
    """``group``, current, indexed, stale, missing, chunks, coverage (percent), density (chunks a file): joined by file.

    ``indexed`` has a row a file with its chunks. Several indexed rows of one current file count once.
    """
    keys = [*group, file]
    best = Window.partitionBy(*keys).orderBy(F.desc("chunks"))
    i = indexed.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, "chunks", F.lit(1).alias("_i"))
    both = current.select(*keys, F.lit(1).alias("_c")).join(i, keys, "full_outer")
    sums = both.groupBy(*group) if group else both.groupBy()
    rows = sums.agg(
        F.count("_c").alias("current"),
        F.count(F.when(F.col("_c").isNotNull() & F.col("_i").isNotNull(), 1)).alias("indexed"),
        F.count(F.when(F.col("_c").isNull(), 1)).alias("stale"),
        F.count(F.when(F.col("_i").isNull(), 1)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("_c").isNotNull(), F.col("chunks"))), F.lit(0)).alias("chunks"),
    )
    return rows.withColumn("coverage", percent(F.col("indexed"), F.col("current"))).withColumn("density", F.when(F.col("indexed") > 0, F.floor(F.col("chunks") * 100.0 / F.col("indexed") + 0.5) / 100).otherwise(0.0))
