"""Queries on the collection's health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kgspark.operators import health as ops
from kgspark.plans.base import AS_OF, FIELDS, FILES, LINKS, NOTES, all_links, linked, parsed, raw
from kgspark.plans.registry import query
from kgspark.sources.collection import table

_AT = dt.datetime.fromisoformat(AS_OF)
_WHOLE = linked(target="target")
_STALE = f"mtime < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"
_DAYS = f"CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(mtime)) / 86400000) AS BIGINT)"


@query("orphans_resolver", _WHOLE + "SELECT path FROM notes WHERE path NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL)")
def orphans_resolver(spark, d):
    return ops.orphans(raw(spark, d), all_links(spark, d, "target")).select("path")


@query("orphans_health", _WHOLE + "SELECT path FROM notes WHERE contains(path, '/') AND path NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL) AND NOT starts_with(path, 'customers/')")
def orphans_health(spark, d):
    links = all_links(spark, d, "target")
    return ops.orphans_below_root(raw(spark, d), links).where(~F.col("path").startswith("customers/")).select("path")


@query("orphans_name", f"WITH {NOTES}, {FILES}, {LINKS} SELECT path FROM files WHERE name NOT IN (SELECT link_path FROM links) AND regexp_replace(path, '\\.md$', '') NOT IN (SELECT link_path FROM links)")
def orphans_name(spark, d):
    return ops.orphans_by_name(raw(spark, d)).select("path")


@query("deadends", f"WITH {NOTES}, all_notes AS (SELECT path, raw FROM notes UNION ALL SELECT 'docs/' || doc_id || '.md', text FROM documents) SELECT path FROM all_notes WHERE NOT regexp_matches(raw, '\\[\\[[^\\]]+\\]\\]')")
def deadends(spark, d):
    """Notes without links, of the linked notes and the documents beside them."""
    docs = table(spark, d, "documents").select(F.lit("main").alias("vault"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("raw"))
    return ops.dead_ends(raw(spark, d).select("vault", "path", "raw").unionByName(docs)).select("path")


@query(
    "unresolved_names",
    f"WITH {NOTES}, {FILES}, {LINKS} SELECT path, link_path AS target, count(*) AS n FROM links WHERE link_path NOT IN (SELECT name FROM files) AND link_path NOT IN (SELECT path FROM files) AND link_path NOT IN (SELECT regexp_replace(path, '\\.md$', '') FROM files) GROUP BY ALL",
)
def unresolved_names(spark, d):
    return ops.unresolved_names(raw(spark, d)).groupBy("path", "target").agg(F.count("*").alias("n"))


_PLACES = r"""lines0 AS (SELECT vault, path, unnest(string_split(raw, chr(10))) AS line, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS line_no FROM notes),
hits AS (SELECT *, regexp_extract_all(line, '!?\[\[([^\]|]+)(?:\|([^\]]+))?\]\]') AS ms, regexp_split_to_array(line, '!?\[\[([^\]|]+)(?:\|([^\]]+))?\]\]') AS gaps FROM lines0 WHERE contains(line, '[[')),
each AS (SELECT vault, path, line_no, ms, gaps, unnest(ms) AS m, unnest(range(len(ms))) AS k FROM hits),
placed AS (SELECT vault, path, line_no, k, trim(regexp_extract(m, '\[\[([^\]|]+)', 1)) AS target,
  1 + length(array_to_string(gaps[1:k + 1], '')) + length(array_to_string(ms[1:k], '')) AS col FROM each)"""
_KEY = r"lower(regexp_replace(regexp_replace(p.target, '^.*/', ''), '\.md$', ''))"


@query(
    "broken_link_occurrences",
    linked(_PLACES)
    + f"""SELECT p.path, p.line_no, CAST(p.col AS BIGINT) AS col, p.k AS index_on_line, p.target FROM placed p
  WHERE p.target || '.md' NOT IN (SELECT path FROM files) AND {_KEY} NOT IN (SELECT k FROM by_name)""",
)
def broken_link_occurrences(spark, d):
    rows = ops.broken_places(raw(spark, d))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.col("col").cast("long").alias("col"), F.col("index_on_line").cast("long").alias("index_on_line"), "target")


@query("broken_targets", _WHOLE + "SELECT target, count(*) AS occurrences, count(DISTINCT path) AS sources FROM resolved WHERE dst IS NULL GROUP BY 1 ORDER BY occurrences DESC, target LIMIT 10")
def broken_targets(spark, d):
    rows = all_links(spark, d, "target").where("dst is null").groupBy("target").agg(F.count("*").alias("occurrences"), F.count_distinct("path").alias("sources"))
    return rows.orderBy(F.desc("occurrences"), "target").limit(10)


@query("stale_notes", f"WITH {NOTES}, {FIELDS} SELECT n.path, {_DAYS} AS days FROM notes n JOIN fields f ON f.path = n.path WHERE {_STALE} AND f.type = 'customer'")
def stale_notes(spark, d):
    return ops.stale(parsed(spark, d), _AT, 365, "CUSTOMER").select("path", "days")


@query(
    "vault_health",
    _WHOLE
    + f"SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM notes WHERE contains(path, '/') AND path NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL)) AS orphans, "
    + f"(SELECT count(*) FROM resolved WHERE dst IS NULL) AS broken_links, (SELECT count(DISTINCT target) FROM resolved WHERE dst IS NULL) AS broken_targets, (SELECT count(*) FROM notes WHERE {_STALE}) AS stale_notes",
)
def vault_health(spark, d):
    return ops.vault_health(raw(spark, d), all_links(spark, d, "target"), _AT, 365).drop("vault")
