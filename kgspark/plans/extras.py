"""Queries on what is laid beside results, daily notes, digests and given graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import annotate as ops
from kgspark.operators.daily import daily_path, random_note
from kgspark.operators.graph import degrees
from kgspark.operators.links import edges as edges_of
from kgspark.operators.search import find_by_name, keyword_search
from kgspark.plans.base import EDGES, FILES, NOTES, VAULT_NOTES, all_links, linked, raw
from kgspark.plans.registry import mil, query
from kgspark.plans.search import bm25_sql
from kgspark.sources.adjacency import edges_from_json
from kgspark.sources.collection import table


@query("daily_paths", "SELECT 'Journal/' || strftime(o_orderdate, '%Y/%m/%d') || '.md' AS path, count(*) AS orders FROM orders GROUP BY 1")
def daily_paths(spark, d):
    path = daily_path(F.col("o_orderdate").cast("timestamp"), "Journal", "YYYY/MM/DD")
    return table(spark, d, "orders").groupBy(path.alias("path")).agg(F.count("*").alias("orders"))


@query("read_random", f"WITH {NOTES} SELECT path, body FROM notes WHERE starts_with(path, 'nations/') ORDER BY md5(path || '#5'), path LIMIT 1")
def read_random(spark, d):
    from kgspark.functions.notes import split_front

    return random_note(raw(spark, d), 5, "nations").select("path", split_front()[1].alias("body"))


_WORDS = "('0x' || substr(h, {k}, 8))::BIGINT"


@query(
    "vault_digest",
    f"WITH {VAULT_NOTES}, o AS (SELECT vault, md5(md5(path) || md5(raw)) AS h FROM notes) SELECT vault, count(*) AS files, concat_ws('-', " + ", ".join(f"CAST(CAST(sum({_WORDS.format(k=8 * k + 1)}) AS BIGINT) AS STRING)" for k in range(4)) + ") AS digest FROM o GROUP BY 1",
)
def vault_digest(spark, d):
    return ops.digest(raw(spark, d, merged=False), ["vault"])


@query("compatibility_receipt", "SELECT count(*) AS total, count(*) FILTER (WHERE label % 3 <> 0 AND len(embedding) = 64) AS compatible, count(*) FILTER (WHERE label % 3 = 0) AS other_model, count(*) FILTER (WHERE label % 3 <> 0 AND len(embedding) <> 64) AS other_dims, count(*) FILTER (WHERE label % 3 = 0 OR len(embedding) <> 64) > 0 AS reindex_required FROM embeddings")
def compatibility_receipt(spark, d):
    rows = table(spark, d, "embeddings").withColumn("model", F.when(F.col("label") % 3 == 0, "old").otherwise("new"))
    return ops.compatibility(rows, "new", 64)


@query("result_previews", r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s+', ' ', 'g')) > 200 THEN substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 200) || '...' ELSE regexp_replace(text, '\s+', ' ', 'g') END AS preview FROM documents")
def result_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", ops.preview(F.col("text")).alias("preview"))


@query("variant_best", f"WITH {bm25_sql(['license'], 20)}, a AS (SELECT * FROM keyword), " + bm25_sql(["apache"], 20).replace("words AS", "words2 AS").replace("FROM words)", "FROM words2)").replace("tf AS", "tf2 AS").replace("FROM tf)", "FROM tf2)").replace("st AS", "st2 AS").replace("FROM tf CROSS JOIN st ", "FROM tf2 CROSS JOIN st2 ").replace("keyword AS", "keyword2 AS") + f" SELECT doc_id, {mil('max(score)')} AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM keyword2) GROUP BY 1")
def variant_best(spark, d):
    """Best score of each document over a query and its expansion."""
    docs = table(spark, d, "documents")
    hits = keyword_search(docs, "license", limit=20).unionByName(keyword_search(docs, "apache", limit=20))
    return ops.best_of_variants(hits, ["doc_id"], ["score"]).select("doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query("annotated_results", linked(f"{EDGES}, i AS (SELECT dst AS node, count(DISTINCT src) AS n FROM edges GROUP BY 1)") + "SELECT f.path, coalesce(i.n, 0) AS in_degree FROM files f LEFT JOIN i ON i.node = f.path WHERE contains(lower(f.name), 'nation_2')")
def annotated_results(spark, d):
    notes = raw(spark, d)
    signals = degrees(notes.select("vault", F.col("path").alias("node")), edges_of(all_links(spark, d))).withColumnRenamed("node", "path")
    return ops.with_signals(find_by_name(notes, "nation_2"), signals).select("path", F.col("graph.in_degree").alias("in_degree"))


@query("given_graph", linked(EDGES) + "SELECT src, dst, cnt FROM edges")
def given_graph(spark, d):
    """The graph as another resolver hands it over, one JSON row a source: the same edges as parsing gives."""
    edges = edges_of(all_links(spark, d))
    rows = edges.groupBy("vault", "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "cnt"))).alias("m"))
    text = F.to_json(F.struct(F.create_map("src", "m").alias("resolved")))
    return edges_from_json(rows.select("vault", text.alias("json")))[0].select("src", "dst", "cnt")


@query("bm25_stemmed")
def bm25_stemmed(spark, d):
    """Keyword search over stems: ``licensed`` finds ``license``."""
    rows = keyword_search(table(spark, d, "documents"), "licensing", limit=10, analyzer="porter")
    return rows.select("doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query("folder_files", f"WITH {NOTES}, {FILES} SELECT dir AS folder, min(name) AS first, max(name) AS last, max(depth) AS depth FROM files GROUP BY 1")
def folder_files(spark, d):
    from kgspark.functions.notes import with_path_parts

    rows = with_path_parts(raw(spark, d)).groupBy(F.col("dir").alias("folder"))
    return rows.agg(F.min("name").alias("first"), F.max("name").alias("last"), F.max("depth").cast("long").alias("depth"))
