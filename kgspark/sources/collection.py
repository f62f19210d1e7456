"""A linked collection derived from the relational tables, and the tables themselves.

One SQL text, in the subset that Spark and DuckDB share, builds the notes: regions, nations, archived nations,
customers and suppliers, with metadata, headings, tasks, tags, links, embeds and missing targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

NL = "chr(10)"


def _front(*lines: str) -> str:
    """SQL of a metadata block; each line is (key, SQL of its value)."""
    return f"'---' || {NL} || " + " || ".join(f"'{k}: ' || {v} || {NL}" for k, v in lines) + f" || '---' || {NL}"


_CUSTOMER, _SUPPLIER = "replace(c_name, '#', '_')", "replace(s_name, '#', '_')"

NOTES_SQL = f"""
SELECT 'geo' AS vault, 'regions/' || r_name || '.md' AS path,
  {_front(("type", "'region'"), ("node_type", "CASE WHEN r_regionkey = 0 THEN 'index' ELSE 'hub' END"), ("priority", "CAST(r_regionkey AS STRING)"))}
  || '# ' || r_name || {NL} || {NL} || 'Hub of #area notes. See [[Atlas]].' || {NL} AS raw,
  CAST('1995-01-01 00:00:00' AS TIMESTAMP) AS mtime
FROM region
UNION ALL
SELECT 'geo', 'nations/' || n_name || '.md',
  {_front(("type", "'nation'"), ("status", "CASE WHEN n_nationkey % 2 = 0 THEN 'Active' ELSE 'draft' END"), ("priority", "CAST(n_nationkey AS STRING)"), ("aliases", "'[' || lower(n_name) || ', N' || CAST(n_nationkey AS STRING) || ']'"))}
  || '# ' || n_name || {NL} || '## Overview' || {NL} || 'In [[' || r_name || ']] and [[regions/' || r_name || '#Overview|region]].' || {NL}
  || '- [ ] review #area' || {NL} || '## Notes' || {NL} || 'Self [[' || n_name || ']].' || {NL},
  CAST('1996-06-15 12:00:00' AS TIMESTAMP)
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geo', 'archive/old/' || n_name || '.md',
  {_front(("type", "'nation'"), ("node_type", "'archive'"))}
  || 'Moved to [[nations/' || n_name || ']], was [[old/' || n_name || ']].' || {NL},
  CAST('1992-03-01 00:00:00' AS TIMESTAMP)
FROM nation
UNION ALL
SELECT 'crm', 'customers/' || {_CUSTOMER} || '.md',
  {_front(("type", "'customer'"), ("segment", "c_mktsegment"), ("balance", "CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING)"), ("tags", "'[' || lower(c_mktsegment) || ', tier' || CAST(c_custkey % 3 AS STRING) || ']'"))}
  || '# ' || {_CUSTOMER} || {NL} || {NL} || 'Lives in [[' || n_name || ']]. Topic [[Missing ' || CAST(c_custkey % 7 AS STRING) || ']] and [[Missing ' || CAST(c_custkey % 7 AS STRING) || ']].' || {NL}
  || '- [ ] call #' || lower(c_mktsegment) || {NL} || '- [x] welcome' || {NL},
  coalesce(last_order, CAST('1992-01-01 00:00:00' AS TIMESTAMP))
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS TIMESTAMP)) AS last_order FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey
UNION ALL
SELECT 'crm', 'suppliers/' || {_SUPPLIER} || '.md',
  {_front(("type", "'supplier'"), ("balance", "CAST(CAST(floor(s_acctbal) AS BIGINT) AS STRING)"))}
  || 'Embed ![[' || n_name || ']] twice [[' || n_name || ']]; buyer [[Customer_' || lpad(CAST(s_suppkey AS STRING), 9, '0') || ']].' || {NL},
  CAST('1997-02-03 04:05:06' AS TIMESTAMP)
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

#: Fields of the notes as SQL knows them, for oracles.
FIELDS_SQL = f"""
SELECT 'regions/' || r_name || '.md' AS path, 'region' AS type, CASE WHEN r_regionkey = 0 THEN 'index' ELSE 'hub' END AS node_type, CAST(NULL AS STRING) AS status,
  CAST(r_regionkey AS BIGINT) AS priority, CAST(NULL AS STRING) AS segment, CAST(NULL AS BIGINT) AS balance, CAST(NULL AS STRING) AS tag1, CAST(NULL AS STRING) AS tag2, CAST(NULL AS STRING) AS alias1, CAST(NULL AS STRING) AS alias2 FROM region
UNION ALL SELECT 'nations/' || n_name || '.md', 'nation', NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'Active' ELSE 'draft' END, n_nationkey, NULL, NULL, NULL, NULL, lower(n_name), 'N' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'archive/old/' || n_name || '.md', 'nation', 'archive', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'customers/' || {_CUSTOMER} || '.md', 'customer', NULL, NULL, NULL, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT), lower(c_mktsegment), 'tier' || CAST(c_custkey % 3 AS STRING), NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'suppliers/' || {_SUPPLIER} || '.md', 'supplier', NULL, NULL, NULL, NULL, CAST(floor(s_acctbal) AS BIGINT), NULL, NULL, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, merged: bool = True) -> DataFrame:
    """(vault, path, raw, mtime) of the derived notes; ``merged`` puts them all in one vault, ``main``."""
    names = ("region", "nation", "customer", "supplier", "orders")
    frames = {n: table(spark, sf_dir, n) for n in names}
    sql = NOTES_SQL
    for n in names:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n} ", f"{word} {{{n}}} ").replace(f"{word} {n}\n", f"{word} {{{n}}}\n")
    notes = spark.sql(sql, **frames)
    return notes.withColumn("vault", F.lit("main")) if merged else notes
