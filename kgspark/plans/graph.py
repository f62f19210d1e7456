"""Queries on the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import graph as ops
from kgspark.operators.links import edges as edges_of
from kgspark.operators.predicates import Condition
from kgspark.plans.base import EDGES, FIELDS, all_links, linked, parsed, raw
from kgspark.plans.registry import mil, query
from kgspark.session import stage

_OUT = "gone AS (SELECT path AS node FROM fields WHERE node_type IN ('generated', 'archive', 'index', 'log'))"
_PRUNED = "kept AS (SELECT path AS node FROM notes WHERE path NOT IN (SELECT node FROM gone)), pruned AS (SELECT src, dst FROM edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))"
_ROUNDS = 20


def _rank_sql() -> str:
    parts = [
        "outs AS MATERIALIZED (SELECT src AS node, count(*) AS outs FROM pruned GROUP BY src)",
        "base AS MATERIALIZED (SELECT kept.node, outs.outs, (SELECT count(*) FROM kept) AS n FROM kept LEFT JOIN outs ON outs.node = kept.node)",
        "r0 AS MATERIALIZED (SELECT node, outs, n, 1.0::DOUBLE / n AS rank FROM base)",
    ]
    for k in range(_ROUNDS):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT b.node, b.outs, b.n, 0.15::DOUBLE / b.n + 0.85::DOUBLE * coalesce(g.got, 0) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE outs IS NULL) / b.n AS rank "
            f"FROM r{k} b LEFT JOIN (SELECT e.dst AS node, sum(r.rank / r.outs) AS got FROM pruned e JOIN r{k} r ON r.node = e.src GROUP BY e.dst) g ON g.node = b.node)"
        )
    return ", ".join(parts) + f", ranked AS (SELECT node, floor(rank * 1e9 + 0.5) / 1e9 AS rank FROM r{_ROUNDS})"


_BANDS = (
    "ind AS (SELECT dst AS node, count(DISTINCT src) AS in_degree FROM pruned GROUP BY dst), cut AS (SELECT quantile_cont(rank, [0.5, 0.8, 0.95, 0.99]) AS p FROM ranked), "
    "banded AS (SELECT r.node, r.rank, CASE WHEN coalesce(i.in_degree, 0) = 0 THEN 5 WHEN rank >= p[4] THEN 0 WHEN rank >= p[3] THEN 1 WHEN rank >= p[2] THEN 2 WHEN rank >= p[1] THEN 3 ELSE 4 END AS level "
    "FROM ranked r LEFT JOIN ind i ON i.node = r.node CROSS JOIN cut)"
)
_ALL = linked(", ".join([EDGES, FIELDS, _OUT, _PRUNED, _rank_sql(), _BANDS]))


def _graph(spark, d, where=None):
    """Nodes, edges and excluded notes, each worked out once and written."""
    notes = parsed(spark, d).select("vault", "path", "props")
    out = stage(ops.excluded(notes, where), "graph-excluded")
    nodes = stage(raw(spark, d).select("vault", F.col("path").alias("node")), "graph-nodes")
    return nodes, stage(edges_of(all_links(spark, d)), "graph-edges"), out


def _ranked(graph):
    kept, pruned = ops.prune(*graph)
    kept, pruned = stage(kept, "graph-kept"), stage(pruned, "graph-pruned")
    ranked = ops.pagerank(kept, pruned, rounds=_ROUNDS, tolerance=0.0)
    return kept, pruned, ranked.withColumn("rank", F.floor(F.col("rank") * 1e9 + 0.5) / 1e9)


def _banded(graph):
    kept, pruned, ranked = _ranked(graph)
    return ops.levels(ranked, pruned.groupBy("vault", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree")))


@query("exclude_default", f"WITH {FIELDS} SELECT path AS node FROM fields WHERE node_type IN ('generated', 'archive', 'index', 'log')")
def exclude_default(spark, d):
    return ops.excluded(parsed(spark, d)).select("node")


@query("exclude_custom", f"WITH {FIELDS} SELECT path AS node FROM fields WHERE type = 'customer' AND segment = 'BUILDING'")
def exclude_custom(spark, d):
    return ops.excluded(parsed(spark, d), [Condition("type", "equals", "Customer"), Condition("segment", "in", ["building"])]).select("node")


@query("excluded_notes", f"WITH {FIELDS} SELECT path AS node, 'node_type' AS reason FROM fields WHERE node_type IN ('generated', 'archive', 'index', 'log')")
def excluded_notes(spark, d):
    notes = parsed(spark, d)
    reasons = [ops.excluded(notes, [c]).withColumn("reason", F.lit(c.field)) for c in ops.DEFAULT_EXCLUDE]
    merged = reasons[0].unionByName(reasons[1]).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reason"))
    return merged.select("node", "reason")


@query("pruned_in_degree", linked(", ".join([EDGES, FIELDS, _OUT, _PRUNED])) + "SELECT dst AS node, count(DISTINCT src) AS in_degree FROM pruned GROUP BY 1")
def pruned_in_degree(spark, d):
    _, pruned = ops.prune(*_graph(spark, d))
    return pruned.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"))


@query("pagerank", _ALL + f"SELECT node, {mil('rank')} AS rank FROM ranked")
def pagerank(spark, d):
    return _ranked(_graph(spark, d))[2].select("node", (F.floor(F.col("rank") * 1e6 + 0.5) / 1e6).alias("rank"))


@query("levels", _ALL + "SELECT node, CAST(level AS INTEGER) AS level FROM banded")
def levels(spark, d):
    return _banded(_graph(spark, d)).select("node", "level")


@query("level_histogram", _ALL + "SELECT CAST(l AS INTEGER) AS level, count(b.node) AS n FROM range(6) t(l) LEFT JOIN banded b ON b.level = l GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM gone")
def level_histogram(spark, d):
    """Nodes by level, and the excluded ones (level null)."""
    graph = _graph(spark, d)
    return ops.histogram(_banded(graph), graph[2]).select(F.col("level").cast("int").alias("level"), "n")


@query(
    "top_contributors",
    _ALL + "SELECT dst, src, place FROM (SELECT e.dst, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY r.rank DESC, e.src) AS place FROM pruned e JOIN ranked r ON r.node = e.src) WHERE place <= 5",
)
def top_contributors(spark, d):
    _, pruned, ranked = _ranked(_graph(spark, d))
    return ops.contributors(pruned, ranked).select("dst", "src", F.col("place").cast("long").alias("place"))


@query(
    "link_hierarchy",
    _ALL
    + ", i0 AS (SELECT dst AS node, count(DISTINCT src) AS n FROM edges GROUP BY 1), o0 AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges GROUP BY 1) "
    + f"SELECT b.node, CAST(b.level AS INTEGER) AS level, {mil('b.rank')} AS rank, coalesce(i0.n, 0) AS in_degree, coalesce(o0.n, 0) AS out_degree FROM banded b LEFT JOIN i0 ON i0.node = b.node LEFT JOIN o0 ON o0.node = b.node "
    + "WHERE starts_with(b.node, 'nations/') ORDER BY b.rank DESC, b.node LIMIT 10",
)
def link_hierarchy(spark, d):
    """Ranking of the whole vault, shown for one scope: the scope filters after ranking."""
    graph = _graph(spark, d)
    nodes, edges, _ = graph
    rows = _banded(graph).join(ops.degrees(nodes, edges), ["vault", "node"]).where(F.col("node").startswith("nations/"))
    rows = rows.orderBy(F.desc("rank"), "node").limit(10)
    return rows.select("node", "level", (F.floor(F.col("rank") * 1e6 + 0.5) / 1e6).alias("rank"), "in_degree", "out_degree")
