"""Common table expressions of the oracles, in DuckDB's dialect, and the notes the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.functions.notes import parse_notes
from kgspark.operators.links import resolved_links
from kgspark.sources.collection import FIELDS_SQL, NOTES_SQL, collection

AS_OF = "1998-08-02 00:00:00"

NOTES = f"raw_notes AS ({NOTES_SQL}), notes AS (SELECT 'main' AS vault, path, raw, mtime, trim(regexp_replace(raw, '(?s)^---\\n(.*?)\\n---\\n', ''), ' ' || chr(10)) AS body FROM raw_notes)"
VAULT_NOTES = NOTES.replace("SELECT 'main' AS vault, path", "SELECT vault, path")
FIELDS = f"fields AS ({FIELDS_SQL})"
FILES = """files AS (SELECT vault, path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS name, regexp_replace(path, '/?[^/]*$', '') AS dir,
  len(string_split(path, '/')) AS depth FROM notes)"""
LINKS = r"""found AS (SELECT vault, path, regexp_extract_all(raw, '!?\[\[([^\]|]+)(?:\|([^\]]+))?\]\]') AS ms FROM notes),
one AS (SELECT vault, path, unnest(ms) AS m, unnest(range(len(ms))) AS ord FROM found),
links AS (SELECT vault, path, ord, starts_with(m, '!') AS is_embed, trim(regexp_extract(m, '\[\[([^\]|]+)', 1)) AS target, nullif(trim(regexp_extract(m, '\|([^\]]+)\]\]', 1)), '') AS alias,
  split_part(trim(regexp_extract(m, '\[\[([^\]|]+)', 1)), '#', 1) AS link_path FROM one)"""
BY_NAME = "by_name AS (SELECT vault, k, path FROM (SELECT vault, lower(name) AS k, path, row_number() OVER (PARTITION BY vault, lower(name) ORDER BY depth, path) AS r FROM files) WHERE r = 1)"
BESIDE = "beside AS (SELECT vault, dir, lower(name) AS k, min(path) AS path FROM files GROUP BY ALL)"


def resolved(target: str = "link_path") -> str:
    return rf"""{FILES}, {LINKS}, {BY_NAME}, {BESIDE},
resolved AS (SELECT l.*, CASE WHEN l.{target} <> '' THEN coalesce(e.path, b.path, n.path) END AS dst FROM links l
  LEFT JOIN files e ON e.vault = l.vault AND e.path = CASE WHEN ends_with(l.{target}, '.md') THEN l.{target} ELSE l.{target} || '.md' END
  LEFT JOIN beside b ON b.vault = l.vault AND b.dir = regexp_replace(l.path, '/?[^/]*$', '') AND b.k = lower(regexp_replace(regexp_replace(l.{target}, '^.*/', ''), '\.md$', ''))
  LEFT JOIN by_name n ON n.vault = l.vault AND n.k = lower(regexp_replace(regexp_replace(l.{target}, '^.*/', ''), '\.md$', '')))"""


def linked(more: str = "", target: str = "link_path", notes: str = NOTES) -> str:
    return f"WITH {notes}, {resolved(target)}{', ' + more if more else ''} "


EDGES = "edges AS (SELECT vault, path AS src, dst, count(*) AS cnt FROM resolved WHERE dst IS NOT NULL AND dst <> path GROUP BY ALL)"


def raw(spark: SparkSession, sf_dir: str, merged: bool = True) -> DataFrame:
    return collection(spark, sf_dir, merged)


def parsed(spark: SparkSession, sf_dir: str, merged: bool = True) -> DataFrame:
    return parse_notes(collection(spark, sf_dir, merged))


def all_links(spark: SparkSession, sf_dir: str, target: str = "link_path", merged: bool = True) -> DataFrame:
    return resolved_links(collection(spark, sf_dir, merged), "raw", target)
