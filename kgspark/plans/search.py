"""Queries that search text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import search as ops
from kgspark.plans.base import FILES, NOTES, VAULT_NOTES, raw
from kgspark.plans.registry import mil, query
from kgspark.sources.collection import table

_DOC_LINES = "doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


@query("search_content", f"WITH {_DOC_LINES} SELECT doc_id, line_no, len(regexp_extract_all(line, '(?i)licen[cs]e|worthless')) AS matches FROM doc_lines WHERE regexp_matches(line, '(?i)licen[cs]e|worthless')")
def search_content(spark, d):
    rows = ops.search_lines(table(spark, d, "documents"), "licen[cs]e|worthless", "text", ("doc_id",))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("matches").cast("long").alias("matches"))


@query(
    "search_all_vaults",
    "WITH files AS (SELECT source, doc_id, text FROM documents WHERE regexp_matches(text, '(?i)version [0-9]')), capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM files), "
    "l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM capped WHERE k <= 5) "
    "SELECT source, doc_id, line_no FROM l WHERE regexp_matches(line, '(?i)version [0-9]')",
)
def search_all_vaults(spark, d):
    rows = ops.search_lines(table(spark, d, "documents"), "version [0-9]", "text", ("source", "doc_id"), per_vault=5)
    return rows.select("source", "doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("search_context", f"WITH {_DOC_LINES}, files AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license') ORDER BY doc_id LIMIT 10) SELECT doc_id, count(*) AS n, string_agg(trim(line), '|' ORDER BY line_no) AS lines FROM doc_lines WHERE doc_id IN (SELECT doc_id FROM files) AND contains(lower(line), 'apache license') GROUP BY 1")
def search_context(spark, d):
    rows = ops.search_context(table(spark, d, "documents"), "Apache License", "text", ("doc_id",))
    return rows.select("doc_id", "n", F.array_join("lines", "|").alias("lines"))


@query("find_note_by_name", f"WITH {NOTES}, {FILES} SELECT path, lower(name) = 'nation_1' AS exact FROM files WHERE contains(lower(name), 'nation_1')")
def find_note_by_name(spark, d):
    return ops.find_by_name(raw(spark, d), "Nation_1").select("path", "exact")


@query("find_note_in_vaults", f"WITH {VAULT_NOTES}, {FILES} SELECT vault, path FROM files WHERE lower(name) = 'africa'")
def find_note_in_vaults(spark, d):
    return ops.find_by_name(raw(spark, d, merged=False), "Africa", exact=True).select("vault", "path")


def bm25_sql(terms: list[str], limit: int = 10) -> str:
    f = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    have = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return (
        f"words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), tf AS (SELECT doc_id, len(w) AS dl, {f} FROM words), "
        f"st AS (SELECT count(*) AS n, avg(dl) AS av, {d} FROM tf), keyword AS (SELECT doc_id, CAST({score} AS DOUBLE) AS score FROM tf CROSS JOIN st WHERE {have} ORDER BY score DESC, doc_id LIMIT {limit})"
    )


@query("bm25_topk", f"WITH {bm25_sql(['apache', 'license', 'version'])} SELECT doc_id, {mil('score')} AS score FROM keyword")
def bm25_topk(spark, d):
    rows = ops.keyword_search(table(spark, d, "documents"), '"Apache" license, version')
    return rows.select("doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query("bm25_all", f"WITH {bm25_sql(['license'], 1 << 40)} SELECT doc_id, {mil('score')} AS score FROM keyword")
def bm25_all(spark, d):
    rows = ops.keyword_search(table(spark, d, "documents"), "license", limit=None)
    return rows.select("doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))
