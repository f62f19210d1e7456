"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SCOPES = threading.local()
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="kgspark-"))
    return f"file://{_LOCAL[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it is done; the table stays, unless ``scratch`` or ``dropped`` ends it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    for own in getattr(_SCOPES, "open", [])[-1:]:
        own.append(out)
    return out


def dropped(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in staged:
        if path := vars(df).get("_folder"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            df._folder = None


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside go at the end, but those given to the function that it yields; an outer scope then has them."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    own: list[DataFrame] = []
    scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        if len(scopes) > 1:
            scopes[-2].append(df)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        dropped(*own)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def one_text_an_id(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of (``keys``, text) for each key, the text with the smallest hash: repeated ids can't swell a bounded sample."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, held_out: int | None) -> DataFrame:
    """At most ``rows`` labelled documents (smallest seeded hashes) of up to ``max_chars`` characters: doc_id, text, y.

    Only ids are ranked; the chosen ones, a bounded set, go to the documents by broadcast, so only the sample's texts
    are shuffled. Ids on fold 0 of ``held_out`` are never chosen. A document labelled twice keeps its largest label; an
    id that several documents have stands for the one whose text has the smallest hash.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if held_out:
        ids = ids.where(id_fold(held_out) != 0)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(rows)
    found = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return one_text_an_id(found, "doc_id", "y")


def collect_sample(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample, in a fixed order."""
    got = sorted(((r["doc_id"], r["text"], r["y"]) for r in sample.collect()), key=lambda r: (r[0], r[1]))
    return [r[1] for r in got], np.array([r[2] for r in got], dtype=np.int64)


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``max_bytes`` of text, at least one row each: bounds the arrays made from them."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > max_bytes:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def keep_rows(docs: DataFrame, decide, max_bytes: int) -> DataFrame:
    """The rows of ``docs`` for whose text ``decide(list of UTF-8 bytes) -> mask`` says so.

    Whole rows go to Python and back once, under their own names, so none clashes with a helper's.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch, "text", max_bytes):
                texts = [x or b"" for x in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(np.asarray(decide(texts), dtype=bool)))

    return docs.mapInArrow(scan, docs.schema)


PACKED, PARTS = "k int, part int, at binary, n binary", 16


def packed_counts(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A few rows for each array of counts, by part of its places: where it isn't 0, and these counts, as bytes."""
    for k, counts in sums.items():
        for part in range(PARTS):
            at = np.arange(len(counts) * part // PARTS, len(counts) * (part + 1) // PARTS)
            at = at[counts[at] != 0]
            if len(at):
                columns = [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([counts[at].astype(np.int64).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["k", "part", "at", "n"])


def summed_counts(packed: DataFrame, arrays: int, width: int) -> np.ndarray:
    """(arrays, width): the sums of all tasks' ``packed_counts``. One row a part and array reaches the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, part, at, n in zip(*(c.to_pylist() for c in b.columns)):
                first = width * part // PARTS
                found = sums.setdefault((k, part), np.zeros(width * (part + 1) // PARTS - first, np.int64))
                found[np.frombuffer(at, np.int32) - first] += np.frombuffer(n, np.int64)
        for (k, part), counts in sums.items():
            at = np.flatnonzero(counts)
            columns = [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([(at + width * part // PARTS).astype(np.int32).tobytes()]), pa.array([counts[at].tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["k", "part", "at", "n"])

    out = np.zeros((arrays, width), np.int64)
    for r in packed.repartition(PARTS, "k", "part").mapInArrow(total, PACKED).collect():
        out[r["k"], np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out


def hash_salt(parts: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), *cols), F.lit(parts)).cast("int")


def salts_for(rows: int, least: int = 16, most: int = 1024, per_cell: int = 200_000) -> int:
    """How many salts keep the cells of a numbering at about ``per_cell`` rows."""
    return int(min(most, max(least, rows // per_cell)))
