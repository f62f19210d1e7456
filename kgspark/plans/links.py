"""Queries on links."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.links import wikilinks
from kgspark.functions.notes import parse_notes, with_path_parts
from kgspark.operators import links as ops
from kgspark.operators.graph import degrees
from kgspark.plans.base import EDGES, FILES, LINKS, NOTES, all_links, linked, parsed, raw
from kgspark.plans.registry import query


@query("outlinks", f"WITH {NOTES}, {LINKS} SELECT path, CAST(ord AS BIGINT) AS ord, is_embed, target, alias, link_path FROM links")
def outlinks(spark, d):
    return wikilinks(raw(spark, d), "raw").select("path", F.col("ord").cast("long").alias("ord"), "is_embed", "target", "alias", "link_path")


@query("resolved_links", linked() + "SELECT path, CAST(ord AS BIGINT) AS ord, link_path, dst FROM resolved")
def resolved_links(spark, d):
    return all_links(spark, d).select("path", F.col("ord").cast("long").alias("ord"), "link_path", "dst")


@query("edges", linked(EDGES) + "SELECT src, dst, cnt FROM edges")
def edges(spark, d):
    return ops.edges(all_links(spark, d)).select("src", "dst", "cnt")


_DEGREE = (
    "i AS (SELECT dst AS node, count(DISTINCT src) AS n FROM edges GROUP BY dst), o AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges GROUP BY src), "
    "deg AS (SELECT path AS node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM notes LEFT JOIN i ON i.node = path LEFT JOIN o ON o.node = path)"
)


@query("link_degree", linked(f"{EDGES}, {_DEGREE}") + "SELECT node, in_degree, out_degree, in_degree / greatest(out_degree, 1) AS ratio FROM deg ORDER BY in_degree DESC, node LIMIT 20")
def link_degree(spark, d):
    nodes = raw(spark, d).select("vault", F.col("path").alias("node"))
    rows = degrees(nodes, ops.edges(all_links(spark, d)))
    return rows.orderBy(F.desc("in_degree"), "node").limit(20).select("node", "in_degree", "out_degree", "ratio")


@query("degrees", linked(f"{EDGES}, {_DEGREE}") + "SELECT node, in_degree, out_degree FROM deg")
def all_degrees(spark, d):
    return degrees(raw(spark, d).select("vault", F.col("path").alias("node")), ops.edges(all_links(spark, d))).select("node", "in_degree", "out_degree")


@query(
    "link_count_stats",
    linked()
    + "SELECT count(*) FILTER (WHERE dst <> path) AS resolved, count(*) FILTER (WHERE dst IS NULL) AS unresolved, count(DISTINCT CASE WHEN dst IS NULL THEN trim(link_path) END) AS distinct_unresolved FROM resolved WHERE link_path <> ''",
)
def link_count_stats(spark, d):
    return ops.link_stats(all_links(spark, d)).drop("vault")


@query("unresolved_rollup", linked() + "SELECT trim(link_path) AS target, count(*) AS occurrences, count(DISTINCT path) AS sources FROM resolved WHERE dst IS NULL AND link_path <> '' GROUP BY 1")
def unresolved_rollup(spark, d):
    return ops.unresolved_rollup(all_links(spark, d))


@query("backlink_counts", linked() + "SELECT dst AS path, count(*) AS links FROM resolved WHERE dst IS NOT NULL GROUP BY 1")
def backlink_counts(spark, d):
    return all_links(spark, d).where("dst is not null").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("links"))


@query(
    "backlinks_of_note",
    f"WITH {NOTES}, {LINKS} SELECT path, count(*) AS links FROM links WHERE path <> 'nations/NATION_7.md' AND (lower(target) IN ('nations/nation_7.md', 'nations/nation_7', 'nation_7', 'nation_7.md') OR ends_with(lower(target), '/nation_7')) GROUP BY 1",
)
def backlinks_of_note(spark, d):
    return ops.backlinks(raw(spark, d), "nations/NATION_7.md").drop("vault")


@query(
    "follow_links",
    linked() + "SELECT r.path, CAST(r.ord AS BIGINT) AS ord, r.dst, length(n.body) AS body_length FROM resolved r JOIN notes n ON n.path = r.dst",
)
def follow_links(spark, d):
    links = all_links(spark, d).select("vault", "path", F.col("ord").cast("long").alias("ord"), "dst")
    notes = parsed(spark, d).select("vault", F.col("path").alias("dst"), F.length("body").cast("long").alias("body_length"))
    return links.join(notes, ["vault", "dst"]).select("path", "ord", "dst", "body_length")


@query("basename_index", f"WITH {NOTES}, {FILES} SELECT lower(name) AS name, count(*) AS files, min(path) AS first_path FROM files GROUP BY 1")
def basename_index(spark, d):
    rows = with_path_parts(raw(spark, d))
    return rows.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query(
    "closest_matches",
    f"WITH {NOTES}, {FILES} SELECT name, distance FROM (SELECT DISTINCT name, CAST(levenshtein(lower(name), 'natoin_1') AS BIGINT) AS distance FROM files) WHERE contains(lower(name), 'natoin_1') OR contains('natoin_1', lower(name)) OR distance <= 3 ORDER BY distance, name LIMIT 3",
)
def closest_matches(spark, d):
    """Names of notes near a misspelled one."""
    names = with_path_parts(raw(spark, d)).select("name")
    return ops.closest(names, "Natoin_1").withColumn("distance", F.col("distance").cast("long"))


@query("notes_scan", f"WITH {NOTES}, {FILES} SELECT n.path, f.name, f.dir, CAST(f.depth AS BIGINT) AS depth, strlen(n.raw) AS size, coalesce(nullif(regexp_extract(n.body, '(?m)^#\\s+(.+)$', 1), ''), f.name) AS title FROM notes n JOIN files f ON f.path = n.path")
def notes_scan(spark, d):
    rows = parse_notes(raw(spark, d))
    return rows.select("path", "name", "dir", F.col("depth").cast("long").alias("depth"), F.octet_length("raw").cast("long").alias("size"), "title")
