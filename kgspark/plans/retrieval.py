"""Vector, fused and evaluated retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import retrieval as ops
from kgspark.operators.search import keyword_search
from kgspark.plans.registry import mil, query
from kgspark.plans.search import bm25_sql
from kgspark.sources.collection import table

_SIX = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def _vec(limit: int = 10, least: float = 0.0, where: str = "TRUE", probe: int = 0) -> str:
    return f"vec AS (SELECT e.vec_id, e.label, {_COS} AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {probe}) q WHERE {where} AND {_COS} >= {least} ORDER BY similarity DESC, e.vec_id LIMIT {limit})"


def _probe(spark, d, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


@query("vector_topk", f"WITH {_vec()} SELECT vec_id, {mil('similarity')} AS similarity FROM vec")
def vector_topk(spark, d):
    return ops.vector_search(table(spark, d, "embeddings"), _probe(spark, d)).select("vec_id", _SIX("similarity").alias("similarity"))


@query("vector_floor", f"WITH {_vec(1 << 40, 0.3)} SELECT vec_id, {mil('similarity')} AS similarity FROM vec")
def vector_floor(spark, d):
    return ops.vector_search(table(spark, d, "embeddings"), _probe(spark, d), least=0.3, limit=None).select("vec_id", _SIX("similarity").alias("similarity"))


@query("similar", f"WITH {_vec(5, 0.0, 'e.vec_id <> 7', 7)} SELECT vec_id, {mil('similarity')} AS similarity FROM vec")
def similar(spark, d):
    return ops.similar(table(spark, d, "embeddings"), 7).select("vec_id", _SIX("similarity").alias("similarity"))


@query("embedding_validity", "SELECT len(embedding) AS dims, count(*) AS vectors, count(*) FILTER (WHERE len(embedding) > 0) AS valid FROM embeddings GROUP BY 1")
def embedding_validity(spark, d):
    rows = table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims"))
    return rows.agg(F.count("*").alias("vectors"), F.count(F.when(ops.valid_vector(), 1)).alias("valid"))


_FUSED = (
    f"{_vec(20)}, {bm25_sql(['license', 'the'], 20)}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM vec), k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM keyword), "
    "fused AS (SELECT coalesce(v.id, k.id) AS id, v.r AS vector_rank, k.r AS keyword_rank, coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0) AS fusion FROM v FULL JOIN k ON v.id = k.id)"
)


def _signals(spark, d):
    vectors = ops.vector_search(table(spark, d, "embeddings"), _probe(spark, d), limit=20).withColumnRenamed("vec_id", "id")
    words = keyword_search(table(spark, d, "documents"), "license the", limit=20).withColumnRenamed("doc_id", "id")
    return vectors, words


def _fused(spark, d):
    vectors, words = _signals(spark, d)
    return ops.fuse({"vector": ops.ranked(vectors, "similarity", "id"), "keyword": ops.ranked(words, "score", "id")}, "id")


@query("rrf_fusion", f"WITH {_FUSED} SELECT id, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank, {mil('fusion')} AS fusion FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("id", F.coalesce(F.col("vector_rank").cast("long"), F.lit(0)).alias("vector_rank"), F.coalesce(F.col("keyword_rank").cast("long"), F.lit(0)).alias("keyword_rank"), _SIX("fusion").alias("fusion"))


_BEST = f"{_FUSED}, best AS (SELECT * FROM (SELECT f.*, d.source, row_number() OVER (PARTITION BY d.source ORDER BY f.fusion DESC, f.id) AS p FROM fused f JOIN documents d ON d.doc_id = f.id) WHERE p = 1)"


@query("hybrid_search", f"WITH {_BEST} SELECT source, id, {mil('fusion')} AS fusion FROM best ORDER BY best.fusion DESC, id LIMIT 10")
def hybrid_search(spark, d):
    """Fusion, one row a file (here: a source), best first."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    best = ops.best_per_file(_fused(spark, d).join(files, "id"), "source", "id")
    return best.orderBy(F.desc("fusion"), "id").limit(10).select("source", "id", _SIX("fusion").alias("fusion"))


@query("legacy_blend", f"WITH {_FUSED} SELECT f.id, {mil('0.7 * coalesce(v.similarity, 0) + 0.3 * coalesce(k.score, 0) / greatest((SELECT max(score) FROM keyword), 1.0)')} AS blend FROM fused f LEFT JOIN vec v ON v.vec_id = f.id LEFT JOIN keyword k ON k.doc_id = f.id")
def legacy_blend(spark, d):
    vectors, words = _signals(spark, d)
    top = words.agg(F.max("score").alias("top"))
    rows = vectors.join(words, "id", "full_outer").crossJoin(F.broadcast(top))  # one row
    return rows.select("id", ops.blend(F.col("similarity"), F.col("score"), F.col("top")).alias("blend")).select("id", _SIX("blend").alias("blend"))


@query("similar_across_labels", f"WITH s AS (SELECT e.label, e.vec_id, floor(({_COS}) * 1000 + 0.5) / 1000 AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q), "
       "t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM s) SELECT label, vec_id, similarity FROM t WHERE r <= 4 ORDER BY similarity DESC, vec_id LIMIT 10")  # fmt: skip
def similar_across_labels(spark, d):
    """Each vault's best, merged on similarities rounded to three places."""
    from pyspark.sql import Window

    vectors = table(spark, d, "embeddings")
    rows = ops.vector_search(vectors, _probe(spark, d), least=-1.0, limit=None, keep=("label",))
    rows = rows.withColumn("similarity", F.floor(F.col("similarity") * 1000 + 0.5) / 1000)
    order = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    rows = rows.withColumn("r", F.row_number().over(order)).where("r <= 4")
    return rows.orderBy(F.desc("similarity"), "vec_id").limit(10).select("label", "vec_id", "similarity")


@query("reranked_search", f"WITH {_FUSED}, first AS (SELECT id, row_number() OVER (ORDER BY fusion DESC, id) AS r FROM fused), s AS (SELECT id, r, CASE WHEN r <= 20 AND id % 2 = 0 THEN id END AS score FROM first) SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, r) AS rank FROM s")
def reranked_search(spark, d):
    """A plugged-in scorer on the first 20: even ids by size, the others keep their order below."""
    from pyspark.sql import Window

    ops.register_reranker("even_ids", lambda q, rows: {r["id"]: float(r["id"]) for r in rows if r["id"] % 2 == 0})
    first = _fused(spark, d).select("id", F.row_number().over(Window.orderBy(F.desc("fusion"), "id")).alias("rank"))
    return ops.rerank(first, "license", "id", "even_ids")[0].select("id", F.col("rank").cast("long").alias("rank"))


@query("graph_annotated", f"WITH {_FUSED}, deg AS (SELECT o_custkey AS id, count(*) AS in_degree FROM orders GROUP BY 1) SELECT f.id, deg.in_degree FROM fused f LEFT JOIN deg ON deg.id = f.id")
def graph_annotated(spark, d):
    """Results with a nullable signal beside them; nothing is reordered or lost."""
    signal = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("in_degree"))
    return _fused(spark, d).select("id").join(signal, "id", "left")


_GOLD = (
    "rk AS (SELECT source, list(doc_id ORDER BY n_chars DESC, doc_id) AS ranked FROM documents GROUP BY 1), rel AS (SELECT d.source, list(d.doc_id) AS relevant FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0 GROUP BY 1), "
    "g AS (SELECT rk.source AS query_id, rk.ranked, coalesce(rel.relevant, []) AS relevant FROM rk LEFT JOIN rel ON rel.source = rk.source), "
    "rn AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents), "
    "hits AS (SELECT rn.source, list(rn.place ORDER BY rn.place) AS hit FROM rn JOIN labels l ON l.doc_id = rn.doc_id WHERE l.quality = 0 GROUP BY 1), "
    "p AS (SELECT g.*, coalesce(hits.hit, []) AS hit FROM g LEFT JOIN hits ON hits.source = g.query_id), "
    "m AS (SELECT query_id, CASE WHEN len(relevant) > 0 THEN CAST(len(list_filter(hit, lambda i: i <= 10)) AS DOUBLE) / len(relevant) ELSE 0 END AS recall, len(list_filter(hit, lambda i: i <= 10)) / 10.0::DOUBLE AS precision, "
    "CASE WHEN len(relevant) > 0 THEN coalesce(list_sum(list_transform(list_filter(hit, lambda i: i <= 10), lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(len(relevant), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, "
    "CASE WHEN len(hit) > 0 THEN 1.0::DOUBLE / hit[1] ELSE 0 END AS rr FROM p)"
)


def _measures(spark, d):
    """Longest documents first as the ranking of each source, junk as what is wanted."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), "n_chars")
    ranking = docs.select("query_id", "item", F.struct(F.isnull("n_chars").alias("none"), (-F.col("n_chars")).alias("n"), "item").alias("rank"))
    junk = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("item"))
    return ops.evaluate_rows(ranking, docs.join(junk, "item").select("query_id", "item"), 10)


@query("eval_by_query", f"WITH {_GOLD} SELECT query_id, {mil('recall')} AS recall, {mil('precision')} AS precision, {mil('ndcg')} AS ndcg, {mil('rr')} AS rr FROM m")
def eval_by_query(spark, d):
    return _measures(spark, d).select("query_id", *[_SIX(c).alias(c) for c in ("recall", "precision", "ndcg", "rr")])


@query("eval_summary", f"WITH {_GOLD} SELECT count(*) AS queries, {mil('avg(recall)')} AS recall, {mil('avg(precision)')} AS precision, {mil('avg(ndcg)')} AS ndcg, {mil('avg(rr)')} AS mrr FROM m")
def eval_summary(spark, d):
    rows = _measures(spark, d).agg(F.count("*").alias("queries"), *[F.avg(c).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("ndcg", "ndcg"), ("rr", "mrr"))])
    return rows.select("queries", *[_SIX(c).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])
