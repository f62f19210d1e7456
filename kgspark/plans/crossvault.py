"""Queries across vaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.uris import SCHEME
from kgspark.operators import crossvault as ops
from kgspark.plans.base import FILES, LINKS, VAULT_NOTES, raw
from kgspark.plans.registry import query
from kgspark.sources.collection import table

_CANDIDATES = f"""WITH {VAULT_NOTES}, {FILES}, {LINKS}, l AS (SELECT vault, path, target, lower(regexp_replace(target, '^.*/', '')) AS k FROM links),
t AS (SELECT lower(name) AS k, count(*) AS n_targets, list(vault || ':' || path ORDER BY vault, path)[1:50] AS some FROM files GROUP BY 1)
SELECT l.vault, l.path, l.target, t.n_targets, array_to_string(t.some, '|') AS targets, count(*) AS n FROM l JOIN t ON t.k = l.k
WHERE NOT EXISTS (SELECT 1 FROM files h WHERE h.vault = l.vault AND lower(h.name) = l.k) GROUP BY ALL"""


@query("cross_vault_candidates", _CANDIDATES)
def cross_vault_candidates(spark, d):
    rows = ops.candidates(raw(spark, d, merged=False))
    rows = rows.withColumn("targets", F.array_join(F.transform("targets", lambda t: F.concat(t["vault"], F.lit(":"), t["path"])), "|"))
    return rows.groupBy("vault", "path", "target", "n_targets", "targets").agg(F.count("*").alias("n"))


#: Declarations of customers' notes by number: URI (SQL), and the status it must get.
_KINDS = [
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION_' || k", "valid"),
    (f"'{SCHEME}://open?vault=GEO&file=nations%2FNATION_' || k || '.md'", "noncanonical"),
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION_' || k || '%23Overview'", "valid"),
    (f"'{SCHEME}://open?vault=sea&file=nations%2FNATION_' || k", "unknown_vault"),
    (f"'{SCHEME}://open?vault=geo'", "malformed"),
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION_' || k || '&path=x'", "unsupported"),
    (f"'{SCHEME}://open?vault=geo&file=..%2Fetc'", "invalid_path"),
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION_9999'", "missing_destination"),
    (f"'{SCHEME}://open?vault=crm&file=suppliers%2FSupplier_' || k", "missing_destination"),
    (f"'{SCHEME}://open?vault=geo&file=a%2'", "malformed"),
    (f"'{SCHEME}://search?vault=geo&file=b'", "unsupported"),
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION+' || k", "missing_destination"),
    (f"'{SCHEME}://open?vault=g+eo&file=nations%2FNATION_' || k", "unknown_vault"),
    (f"'{SCHEME}://open?vault=geo&file=nations%2FNATION_%FF'", "malformed"),
]
_URIS = (
    "SELECT 'crm' AS vault, 'customers/' || replace(c_name, '#', '_') || '.md' AS path, c_custkey % %d AS kind, CAST(c_nationkey AS STRING) AS k FROM customer".replace("%d", str(len(_KINDS)))
)
_TEXT = "CASE kind " + " ".join(f"WHEN {i} THEN {u}" for i, (u, _) in enumerate(_KINDS)) + " END"
_STATUS = "CASE kind " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(_KINDS)) + " END"


def _checked(spark, d):
    rows = spark.sql(f"SELECT vault, path, {_TEXT} AS uri FROM ({_URIS.replace('FROM customer', 'FROM {customer}')})", customer=table(spark, d, "customer"))
    files = raw(spark, d, merged=False).select("vault", "path")
    vaults = spark.createDataFrame([("geo",), ("crm",)], "vault string")
    return ops.validate(rows, files, vaults)


@query("uri_status", f"WITH u AS ({_URIS}) SELECT path, {_TEXT} AS uri, {_STATUS} AS status FROM u")
def uri_status(spark, d):
    return _checked(spark, d).select("path", "uri", "status")


@query("uri_excluded", f"WITH u AS ({_URIS}) SELECT {_STATUS} AS status, count(*) AS n FROM u WHERE kind > 2 GROUP BY 1")
def uri_excluded(spark, d):
    return ops.excluded(_checked(spark, d))


@query(
    "uri_overlay",
    f"WITH u AS ({_URIS}) SELECT path, 'geo' AS to_vault, 'nations/NATION_' || k || '.md' AS to_path, 1::BIGINT AS total, CAST(kind <> 1 AS BIGINT) AS canonical, CAST(kind = 1 AS BIGINT) AS noncanonical, CASE WHEN kind = 2 THEN 'Overview' ELSE '' END AS subpaths, '{SCHEME}://open?vault=geo&file=nations%2FNATION_' || k AS canonical_uri FROM u WHERE kind <= 2",
)
def uri_overlay(spark, d):
    rows = ops.overlay(_checked(spark, d))
    return rows.select("path", "to_vault", "to_path", "total", "canonical", "noncanonical", F.array_join(F.transform("subpaths", lambda s: s["subpath"]), ",").alias("subpaths"), "canonical_uri")
