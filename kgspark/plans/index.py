"""Queries on chunks, manifests and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.chunks import chunk_texts
from kgspark.operators import index as ops
from kgspark.plans.registry import query
from kgspark.sources.collection import table


@query("chunk_manifest")
def chunk_manifest(spark, d):
    rows = chunk_texts(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", "block_id", "start_line", "chunk_index", "chunk_count", F.octet_length("embedding_text").alias("bytes"), "content_hash")


@query("chunk_totals", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE text <> ''")
def chunk_totals(spark, d):
    """Chunks joined are the text: their bytes add up."""
    rows = chunk_texts(table(spark, d, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.sum(F.octet_length("source_text")).alias("bytes"))


def _manifests(spark, d):
    """What the index should hold, and what it holds: an older state in which some rows differ or are missing."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("b0").alias("block_id"), F.md5("text").alias("content_hash"), F.lit("m1").alias("model"))
    stored = docs.where("path % 10 <> 0").withColumn("content_hash", F.when(F.col("path") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return docs.where("path % 13 <> 0"), stored


_STORED = "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 0"


@query("manifest_diff", f"SELECT e.doc_id AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.h = md5(e.text) THEN 'same' ELSE 'changed' END AS state FROM documents e LEFT JOIN ({_STORED}) s ON s.path = e.doc_id WHERE e.doc_id % 13 <> 0")
def manifest_diff(spark, d):
    return ops.changed_files(*_manifests(spark, d))


@query("stale_index_paths", f"SELECT path FROM ({_STORED}) WHERE path % 13 = 0")
def stale_index_paths(spark, d):
    expected, stored = _manifests(spark, d)
    return ops.stale_files(stored, expected)


@query("index_merge", f"SELECT s.path, s.h AS content_hash FROM ({_STORED}) s WHERE s.path % 13 <> 0 AND s.path % 7 <> 0 UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id % 13 <> 0 AND (doc_id % 10 = 0 OR doc_id % 7 = 0)")
def index_merge(spark, d):
    """Replace the rows of new and changed files, drop stale ones, keep the rest."""
    expected, stored = _manifests(spark, d)
    todo = ops.changed_files(expected, stored).where("state <> 'same'")
    fresh = expected.join(todo.select("path"), "path", "left_semi")
    return ops.merge(stored, fresh, ops.stale_files(stored, expected)).select("path", "content_hash")


@query("index_stats", "SELECT count(*) AS chunks, count(DISTINCT conv_id) AS files, max(turn) AS last_updated FROM conversations")
def index_stats(spark, d):
    rows = table(spark, d, "conversations").withColumn("updated_at", F.col("turn"))
    return ops.index_stats(rows, "conv_id")


@query("path_stats", "SELECT conv_id, count(*) AS chunks, max(turn) AS last_turn FROM conversations GROUP BY 1")
def path_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.max("turn").alias("last_turn"))


_COVER = (
    "idx AS (SELECT CASE WHEN doc_id % 17 = 0 THEN doc_id + 100000000 ELSE doc_id END AS path, source, n_chars // 1000 + 1 AS chunks FROM documents WHERE doc_id % 5 <> 0), cur AS (SELECT doc_id AS path, source FROM documents), "
    "j AS (SELECT coalesce(cur.source, idx.source) AS source, cur.path AS c, idx.path AS i, idx.chunks FROM cur FULL JOIN idx ON cur.path = idx.path AND cur.source = idx.source)"
)
_SUMS = "count(c) AS current, count(*) FILTER (WHERE c IS NOT NULL AND i IS NOT NULL) AS indexed, count(*) FILTER (WHERE c IS NULL) AS stale, count(*) FILTER (WHERE i IS NULL) AS missing, CAST(coalesce(sum(chunks) FILTER (WHERE c IS NOT NULL), 0) AS BIGINT) AS chunks"
_PERCENT = "CASE WHEN current <= 0 OR indexed <= 0 THEN 0.0::DOUBLE WHEN indexed = current THEN 100.0::DOUBLE ELSE least(greatest(floor(indexed * 10000.0::DOUBLE / current + 0.5) / 100, 0.01::DOUBLE), 99.99::DOUBLE) END AS coverage"


def cover_frames(spark, d):
    docs = table(spark, d, "documents")
    moved = F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") + 100_000_000).otherwise(F.col("doc_id"))
    indexed = docs.where("doc_id % 5 <> 0").select("source", moved.alias("path"), (F.floor(F.col("n_chars") / 1000) + 1).alias("chunks"))
    return indexed, docs.select("source", F.col("doc_id").alias("path"))


@query("index_coverage", f"WITH {_COVER}, s AS (SELECT source, {_SUMS} FROM j GROUP BY 1) SELECT *, {_PERCENT} FROM s")
def index_coverage(spark, d):
    return ops.coverage(*cover_frames(spark, d), ["source"]).drop("density")


@query("ecosystem_stats", f"WITH {_COVER}, s AS (SELECT coalesce(source, '(all)') AS source, {_SUMS} FROM j GROUP BY GROUPING SETS ((source), ())) SELECT *, {_PERCENT} FROM s")
def ecosystem_stats(spark, d):
    """Coverage of each vault and of all, in one pass over the joined rows."""
    indexed, current = cover_frames(spark, d)
    both = current.select("source", "path", F.lit(1).alias("_c")).join(indexed.select("source", "path", "chunks", F.lit(1).alias("_i")), ["source", "path"], "full_outer")
    sums = both.groupingSets([[F.col("source")], []], F.col("source")).agg(
        F.count("_c").alias("current"), F.count(F.when(F.col("_c").isNotNull() & F.col("_i").isNotNull(), 1)).alias("indexed"),
        F.count(F.when(F.col("_c").isNull(), 1)).alias("stale"), F.count(F.when(F.col("_i").isNull(), 1)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("_c").isNotNull(), F.col("chunks"))), F.lit(0)).alias("chunks"),
    )
    return sums.withColumn("source", F.coalesce("source", F.lit("(all)"))).withColumn("coverage", ops.percent(F.col("indexed"), F.col("current")))
