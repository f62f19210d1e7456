"""Queries on metadata, tags, tasks and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import notes as fn
from kgspark.functions.jslike import field, js_string
from kgspark.operators.predicates import Condition, query_notes
from kgspark.plans.base import FIELDS, FILES, NOTES, parsed, raw
from kgspark.plans.registry import query
from kgspark.sources.markdown import folders

#: op -> (condition, SQL on the fields)
CASES = {
    "equals": (Condition("status", "equals", "ACTIVE"), "lower(coalesce(status, 'undefined')) = 'active'"),
    "equals_in_list": (Condition("tags", "equals", "tier1"), "tag2 = 'tier1'"),
    "not_equals": (Condition("status", "not_equals", "draft"), "lower(coalesce(status, 'undefined')) <> 'draft'"),
    "contains": (Condition("tags", "contains", "IER2"), "contains(coalesce(tag1, ''), 'ier2') OR contains(coalesce(tag2, ''), 'ier2')"),
    "not_contains": (Condition("segment", "not_contains", "auto"), "NOT contains(lower(coalesce(segment, '')), 'auto')"),
    "in": (Condition("priority", "in", [1, "3", 24]), "priority IN (1, 3, 24)"),
    "not_in": (Condition("type", "not_in", ["customer", "supplier"]), "type NOT IN ('customer', 'supplier')"),
    "exists": (Condition("balance", "exists"), "balance IS NOT NULL"),
    "not_exists": (Condition("priority", "not_exists"), "priority IS NULL"),
    "greater_than": (Condition("balance", "greater_than", 5000), "balance > 5000"),
    "less_than": (Condition("balance", "less_than", "-10"), "balance < -10"),
}


def _case(op: str, where: Condition, sql: str) -> None:
    query(f"query_notes_{op}", f"WITH {FIELDS} SELECT path FROM fields WHERE {sql}")(lambda spark, d: query_notes(parsed(spark, d), [where], limit=None).select("path"))


for _op, (_where, _sql) in CASES.items():
    _case(_op, _where, _sql)


@query("query_notes_sorted", f"WITH {FIELDS} SELECT path, CAST(priority AS STRING) AS priority FROM fields WHERE starts_with(path, 'nations/') ORDER BY CAST(priority AS STRING) DESC, path LIMIT 7")
def query_notes_sorted(spark, d):
    return query_notes(parsed(spark, d), start="nations", fields=["priority"], sort_by="-priority", limit=7).select("path", "priority")


@query("query_notes_projected", f"WITH {FIELDS} SELECT path, type, segment, CASE WHEN tag1 IS NOT NULL THEN tag1 || ',' || tag2 END AS tags FROM fields WHERE type = 'customer' AND balance > 0")
def query_notes_projected(spark, d):
    where = [Condition("type", "equals", "customer"), Condition("balance", "greater_than", 0)]
    return query_notes(parsed(spark, d), where, fields=["type", "segment", "tags"], limit=None).drop("vault")


_TAGS = f"""tags0 AS (SELECT path, tag1 AS tag, 'metadata' AS origin FROM fields WHERE tag1 IS NOT NULL UNION ALL SELECT path, tag2, 'metadata' FROM fields WHERE tag2 IS NOT NULL
UNION ALL SELECT path, unnest(regexp_extract_all(raw, '(?:^|\\s)#([a-zA-Z][a-zA-Z0-9_/-]*)', 1)), 'inline' FROM notes)"""


@query("tag_counts", f"WITH {NOTES}, {FIELDS}, {_TAGS} SELECT tag, count(*) AS n FROM tags0 GROUP BY 1")
def tag_counts(spark, d):
    return fn.tags(parsed(spark, d)).groupBy("tag").agg(F.count("*").alias("n"))


@query("tag_info", f"WITH {NOTES}, {FIELDS} SELECT n.path FROM notes n JOIN fields f ON f.path = n.path WHERE f.tag1 = 'building' OR contains(n.raw, '#building')")
def tag_info(spark, d):
    notes = parsed(spark, d)
    own = F.array_contains(fn.text_list(field(F.col("props"), "tags")), "building")
    return notes.where(own | F.contains("raw", F.lit("#building"))).select("path")


_KEYS = " UNION ALL ".join(f"SELECT path, '{k}' AS key, {v} AS value FROM fields WHERE {k2} IS NOT NULL" for k, v, k2 in [
    ("type", "type", "type"), ("node_type", "node_type", "node_type"), ("status", "status", "status"), ("priority", "CAST(priority AS STRING)", "priority"),
    ("segment", "segment", "segment"), ("balance", "CAST(balance AS STRING)", "balance"), ("tags", "tag1 || ',' || tag2", "tag1"), ("aliases", "alias1 || ',' || alias2", "alias1")])


@query("property_counts", f"WITH {FIELDS}, keyed AS ({_KEYS}) SELECT key, count(*) AS n FROM keyed GROUP BY 1")
def property_counts(spark, d):
    return fn.properties(parsed(spark, d)).groupBy("key").agg(F.count("*").alias("n"))


@query("property_table", f"WITH {FIELDS}, keyed AS ({_KEYS}) SELECT path, key, value FROM keyed")
def property_table(spark, d):
    return fn.properties(parsed(spark, d)).select("path", "key", js_string(F.col("value")).alias("value"))


@query("property_values", f"WITH {FIELDS} SELECT DISTINCT value FROM (SELECT tag1 AS value FROM fields UNION ALL SELECT tag2 FROM fields) WHERE value IS NOT NULL")
def property_values(spark, d):
    return parsed(spark, d).select(F.explode(fn.text_list(field(F.col("props"), "tags"))).alias("value")).distinct()


@query("property_read", f"WITH {FIELDS} SELECT path, status AS value FROM fields WHERE status IS NOT NULL")
def property_read(spark, d):
    v = field(F.col("props"), "status")
    return parsed(spark, d).where(v.isNotNull()).select("path", js_string(v).alias("value"))


@query("aliases", f"WITH {FIELDS} SELECT path, alias1 AS alias FROM fields WHERE alias1 IS NOT NULL UNION ALL SELECT path, alias2 FROM fields WHERE alias2 IS NOT NULL")
def aliases(spark, d):
    return parsed(spark, d).select("path", F.explode(fn.text_list(field(F.col("props"), "aliases"))).alias("alias"))


_LINES = "lines0 AS (SELECT path, unnest(string_split(raw, chr(10))) AS line, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS line_no FROM notes)"


@query("tasks", f"WITH {NOTES}, {_LINES} SELECT path, line_no, regexp_extract(line, '^(\\s*[-*]\\s+)\\[(.)\\]\\s+(.*)', 2) IN ('x', 'X') AS done, regexp_extract(line, '^(\\s*[-*]\\s+)\\[(.)\\]\\s+(.*)', 3) AS task FROM lines0 WHERE regexp_matches(line, '^(\\s*[-*]\\s+)\\[(.)\\]\\s+(.*)')")
def tasks(spark, d):
    return fn.tasks(raw(spark, d)).select("path", F.col("line_no").cast("long").alias("line_no"), "done", "task")


@query("outline", f"WITH {NOTES}, {_LINES} SELECT path, line_no, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#+\\s+(.+)', 1) AS heading, repeat('  ', CAST(length(regexp_extract(line, '^(#+)', 1)) - 1 AS BIGINT)) || regexp_extract(line, '^#+\\s+(.+)', 1) AS shown FROM lines0 WHERE regexp_matches(line, '^#{{1,6}}\\s+.+')")
def outline(spark, d):
    return fn.outline(raw(spark, d)).select("path", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("long").alias("level"), "heading", "shown")


@query("word_count", f"WITH {NOTES} SELECT path, len(regexp_extract_all(body, '\\S+')) AS words, length(body) AS characters FROM notes")
def word_count(spark, d):
    return fn.word_counts(parsed(spark, d)).drop("vault")


@query("list_folders", f"WITH {NOTES}, {FILES} SELECT DISTINCT dir AS folder FROM files UNION SELECT 'archive'")
def list_folders(spark, d):
    return folders(raw(spark, d)).select("folder")


@query("folder_info", f"WITH {NOTES}, {FILES} SELECT f.dir AS folder, count(*) AS notes, CAST(sum(strlen(n.raw)) AS BIGINT) AS bytes FROM notes n JOIN files f ON f.path = n.path GROUP BY 1")
def folder_info(spark, d):
    return fn.with_path_parts(raw(spark, d)).groupBy(F.col("dir").alias("folder")).agg(F.count("*").alias("notes"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("vault_info", f"WITH {NOTES}, {FILES} SELECT count(*) AS notes, count(DISTINCT f.dir) + 1 AS folders, CAST(sum(strlen(n.raw)) AS BIGINT) AS bytes FROM notes n JOIN files f ON f.path = n.path")
def vault_info(spark, d):
    notes = raw(spark, d)
    sums = notes.agg(F.count("*").alias("notes"), F.sum(F.octet_length("raw")).alias("bytes"))
    return sums.join(folders(notes).agg(F.count("*").alias("folders"))).select("notes", "folders", "bytes")


@query("list_files_glob", f"WITH {NOTES}, {FILES} SELECT path FROM files WHERE regexp_matches(name || '.md', '(?i)^nation_.\\.md$')")
def list_files_glob(spark, d):
    from kgspark.operators.search import glob_regex

    return fn.with_path_parts(raw(spark, d)).where(F.concat("name", F.lit(".md")).rlike(glob_regex("NATION_?.md"))).select("path")
