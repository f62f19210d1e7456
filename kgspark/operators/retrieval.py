"""Vector search, rank fusion, reranking and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import stage

RRF_K = 60


def valid_vector(v: str = "embedding", dims: int | None = None) -> Column:
    """Not empty, all finite, and of ``dims`` numbers where given."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = (F.size(v) > 0) & finite
    return F.coalesce(ok & (F.size(v) == dims) if dims else ok, F.lit(False))


def cosine(v: str, query: Sequence[float]) -> Column:
    """Cosine with a constant vector in double precision; 0 where a length is zero.

    The sum is spelled out over the constant's coordinates, so it compiles into the scan's loop.
    """
    at = lambda i: F.get(v, F.lit(i)).cast("double")
    dot = sum((at(i) * float(q) for i, q in enumerate(query)), F.lit(0.0))
    own = sum((at(i) * at(i) for i in range(len(query))), F.lit(0.0))
    length = float(sum(float(q) ** 2 for q in query)) ** 0.5
    return F.when((own == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(own) * length))


def vector_search(vectors: DataFrame, query: Sequence[float], key: str = "vec_id", column: str = "embedding", least: float = 0.0, limit: int | None = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``keep``, similarity): exact scan of the vectors of the query's size; ties by key."""
    rows = vectors.where(valid_vector(column, len(query))).select(key, *keep, cosine(column, query).alias("similarity"))
    rows = rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key)
    return rows.limit(limit) if limit else rows


def search_many(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", limit: int = 10, block: int = 2048) -> DataFrame:
    """(query, key, similarity): the ``limit`` nearest vectors of each of ``queries`` (a subset of rows), itself not among them.

    Queries go to the tasks in blocks of about ``block``, each block a scan of all vectors: products of small matrices,
    of which a task hands on the best of each query. Similarities count to nine places; ties by key. Vectors of another
    length or with bad numbers are neither queries nor found.
    """
    kind = dict(vectors.dtypes)[key]
    rows = vectors.where(valid_vector(column)).select(key, column)
    asked = queries.where(valid_vector(column)).select(key, column)
    parts = max(1, -(-asked.count() // block))
    spark, found = vectors.sparkSession, []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(parts)) == part).orderBy(key).collect()  # about ``block`` rows
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in sorted({len(r[column]) for r in own}):
            some = [r for r in own if len(r[column]) == size]
            by_size[size] = ([r[key] for r in some], unit(np.array([r[column] for r in some], dtype=np.float64)))
        shared = spark.sparkContext.broadcast(by_size)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                ids, lists = np.asarray(b.column(0)), b.column(1)
                sizes = np.diff(np.asarray(lists.offsets))
                flat = np.asarray(lists.flatten(), dtype=np.float64)
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                for size, (names, matrix) in shared.value.items():
                    at = np.flatnonzero(sizes == size)
                    for lo in range(0, len(at), 1024):
                        k = at[lo : lo + 1024]
                        near = np.round(matrix @ unit(flat[start[k][:, None] + np.arange(size)]).T, 9)
                        near[np.array(names)[:, None] == ids[k][None, :]] = -2.0  # itself
                        old = best.get(size, (np.zeros((len(names), 0), ids.dtype), np.zeros((len(names), 0))))
                        all_ids = np.concatenate([old[0], np.broadcast_to(ids[k], near.shape)], axis=1)
                        all_near = np.concatenate([old[1], near], axis=1)
                        order = np.lexsort((all_ids, -all_near), axis=1)[:, :limit]
                        best[size] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1)
            for size, (ids, near) in best.items():
                names = np.repeat(np.array(shared.value[size][0]), ids.shape[1])
                real = near.ravel() > -2.0
                yield pa.RecordBatch.from_arrays([pa.array(names[real]), pa.array(ids.ravel()[real]), pa.array(near.ravel()[real])], ["query", key, "similarity"])

        hits = rows.mapInArrow(scan, f"query {kind}, {key} {kind}, similarity double")
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
        top = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
        found.append(stage(top, "search-many") if parts > 1 else top)
    return reduce(DataFrame.unionByName, found)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def expand(query: str, expander: Callable[[str], Sequence[str]] | None = None, most: int = 2) -> list[str]:
    """The query and up to ``most`` other wordings of more than 3 and less than 200 characters; a failing service adds none."""
    try:
        lines = [x.strip() for x in (expander(query) if expander else ())]
    except Exception:  # a failing service never fails the search
        lines = []
    return [query, *[x for x in lines if 3 < len(x) < 200][:most]]


def texts_of(query: str, expander: Callable[[str], Sequence[str]] | None = None, hypothesis: str | None = None) -> tuple[list[str], list[str]]:
    """(texts to embed, texts to search by keyword): a hypothetical answer is embedded only, the query's variants are both."""
    variants = expand(query, expander)
    return [*variants, *([hypothesis] if hypothesis and hypothesis.strip() else [])], variants


def hybrid(vectors: DataFrame, keywords: Callable[[str, int], DataFrame], embed: Callable[[str], Sequence[float]], query: str, key: str = "vec_id", limit: int = 10, least: float = 0.5,
           expander: Callable[[str], Sequence[str]] | None = None, hypothesis: str | None = None) -> DataFrame:
    """(key, fusion, vector_rank, keyword_rank): fused search over all variants of a query.

    Each text brings up to twice ``limit`` candidates; over the variants of one signal a key's best score counts, and
    the two signals are fused by rank. ``least`` cuts vectors only.
    """
    to_embed, to_find = texts_of(query, expander, hypothesis)
    near = [vector_search(vectors, list(embed(t)), key, least=least, limit=2 * limit).select(key, F.round("similarity", 9).alias("similarity")) for t in to_embed]
    said = [keywords(t, 2 * limit).select(key, "score") for t in to_find]
    signals = {"vector": ranked(reduce(DataFrame.unionByName, near), "similarity", key), "keyword": ranked(reduce(DataFrame.unionByName, said), "score", key)}
    return fuse(signals, key).orderBy(F.desc("fusion"), key).limit(limit)


def similar(vectors: DataFrame, to: int, key: str = "vec_id", column: str = "embedding", limit: int = 5) -> DataFrame:
    """Nearest others to a stored vector."""
    row = vectors.where((F.col(key) == to) & valid_vector(column)).select(column).first()
    if row is None:
        return vectors.select(key, F.lit(0.0).alias("similarity")).limit(0)
    return vector_search(vectors, list(row[0]), key, column, 0.0, limit + 1).where(F.col(key) != to).limit(limit)


def similar_files(stored: DataFrame, file: object, key: str = "path", chunk: str = "block_id", column: str = "embedding", limit: int = 5, least: float = 0.0) -> DataFrame:
    """(key, similarity): the files whose best chunk is nearest to a file, by the first of its chunks that has a vector."""
    row = stored.where((F.col(key) == file) & valid_vector(column)).orderBy(chunk).select(column).limit(1).collect()
    if not row:
        return stored.select(key, F.lit(0.0).alias("similarity")).limit(0)
    near = vector_search(stored.where(F.col(key) != file), list(row[0][column]), chunk, column, least, None, (key,))
    return near.groupBy(key).agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), key).limit(limit)


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """(key, rank) from 1, best first; a key's first occurrence counts, ties by key. For result lists, which are short."""
    best = df.groupBy(key).agg(F.max(score).alias("_s"))
    return best.select(key, F.row_number().over(Window.orderBy(F.desc("_s"), key)).alias("rank"))


def fuse(signals: dict[str, DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, fusion, a rank column a signal): reciprocal rank fusion; what a signal lacks adds nothing."""
    out: DataFrame | None = None
    for name, frame in signals.items():
        own = frame.select(key, F.col("rank").alias(f"{name}_rank"))
        out = own if out is None else out.join(own, key, "full_outer")
    terms = [F.coalesce(1.0 / (k + F.col(f"{name}_rank")), F.lit(0.0)) for name in signals]
    return out.withColumn("fusion", sum(terms, F.lit(0.0)))


def best_per_file(fused: DataFrame, file: str, key: str) -> DataFrame:
    """The best fused row of each file; ties by key."""
    order = Window.partitionBy(file).orderBy(F.desc("fusion"), key)
    return fused.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def blend(similarity: Column, keyword: Column, top_keyword: Column) -> Column:
    """The older mixture, for information: 0.7 similarity and 0.3 keyword score over the best one (1 at least)."""
    return 0.7 * F.coalesce(similarity, F.lit(0.0)) + 0.3 * F.coalesce(keyword, F.lit(0.0)) / F.greatest(F.coalesce(top_keyword, F.lit(1.0)), F.lit(1.0))


RERANKERS: dict[str, Callable[[str, list], dict]] = {}


def register_reranker(name: str, scorer: Callable[[str, list], dict]) -> None:
    """``scorer(query, rows) -> {key: score}`` over at most the window's rows."""
    RERANKERS[name] = scorer


def rerank(results: DataFrame, query: str, key: str, name: str = "none", window: int = 20) -> tuple[DataFrame, str | None]:
    """(results in new order, why nothing changed). Only the first ``window`` rows go to the scorer; unscored ones sink, in order."""
    scorer = RERANKERS.get(name)
    if scorer is None:
        return results, f"no reranker named {name}" if name != "none" else "none"
    rows = results.orderBy("rank").limit(window).collect()
    try:
        scores = scorer(query, rows)
    except Exception as e:  # a failing service never fails the search
        return results, f"failed: {type(e).__name__}"
    known = [(r[key], float(scores[r[key]])) for r in rows if r[key] in scores]
    if not known:
        return results, "no scores"
    frame = results.sparkSession.createDataFrame(known, [key, "rerank_score"]).withColumn(key, F.col(key).cast(results.schema[key].dataType))
    order = Window.orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return results.join(F.broadcast(frame), key, "left").withColumn("rank", F.row_number().over(order)), None


def evaluate(gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, ndcg, rr) of (query_id, ranked array, relevant array).

    Recall and precision count a repeated result once, gain counts each; precision divides by k; no relevant ones give 0.
    """
    top, want = F.slice("ranked", 1, k), F.array_distinct("relevant")
    hits = F.size(F.array_intersect(F.array_distinct(top), want))
    gain = lambda x, i: F.when(F.array_contains("relevant", x), 1 / F.log2(i + 2)).otherwise(0.0)
    dcg = F.aggregate(F.transform(top, gain), F.lit(0.0), lambda a, x: a + x)
    many = F.least(F.size(want), F.lit(k))
    ideal = F.when(many > 0, F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: 1 / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    places = F.filter(F.transform("ranked", lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda i: i.isNotNull())
    return gold.select(
        "query_id",
        F.when(F.size(want) > 0, hits / F.size(want)).otherwise(0.0).alias("recall"),
        (hits / F.lit(k)).alias("precision"),
        F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.size(places) > 0, 1 / F.get(places, F.lit(0))).otherwise(0.0).alias("rr"),
    )


def evaluate_rows(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The same measures from rows, for rankings too long for arrays: (query_id, item, rank) and (query_id, item).

    ``rank`` may be any column that orders a query's items, best first and without ties: only the first ``k`` are
    numbered. The first relevant item's rank is one more than the items ahead of it, counted over the whole ranking,
    so neither a list nor a numbering of all items is made.
    """
    want = relevant.select("query_id", "item").distinct()
    places = Window.partitionBy("query_id").orderBy("rank")
    top = ranking.withColumn("_place", F.row_number().over(places)).where(F.col("_place") <= k)
    hits = top.join(want.withColumn("_hit", F.lit(True)), ["query_id", "item"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    sums = hits.groupBy("query_id").agg(
        F.count(F.when(hit, 1)).alias("_n"),
        F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("_place") + 1))), F.lit(0.0)).alias("_dcg"),
    )
    best = ranking.join(want, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("_best"))
    # salted: one query's ranking may be most of the rows
    best = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    ahead = ranking.select("query_id", "rank", F.pmod(F.xxhash64("item"), F.lit(64)).cast("int").alias("_salt"))
    ahead = ahead.join(best, ["query_id", "_salt"]).where(F.col("rank") <= F.col("_best"))
    sums = sums.join(ahead.groupBy("query_id").agg(F.count("*").alias("_first")), "query_id", "left")
    sums = sums.join(want.groupBy("query_id").agg(F.count("*").alias("_want")), "query_id", "left").fillna(0, ["_want"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least("_want", F.lit(k)), F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    some = F.col("_want") > 0
    return sums.select(
        "query_id",
        F.when(some, F.col("_n") / F.col("_want")).otherwise(0.0).alias("recall"),
        (F.col("_n") / F.lit(k)).alias("precision"),
        F.when(some, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("_first").isNotNull(), 1 / F.col("_first")).otherwise(0.0).alias("rr"),
    )
