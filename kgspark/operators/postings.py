"""Keyword search over stored postings, by blocks of documents with each block's best score of a term.

A document's block is its class of length and, in large classes, a part of it by hash: the same for all of its terms. A
table beside the postings has, for each term and block, the number of rows and the best that a row scores. A search of
single words reads the most promising blocks first and leaves unread what can't reach the last place any more.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgspark.operators.search import B, K1
from kgspark.session import stage

BUCKETS = 256
_WORD = r"[^\p{L}\p{N}]+"


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else bare(t))


def folded(text: Column) -> Column:
    """Small letters without diacritics. Only texts beyond ASCII leave the JVM."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.lower(F.when(other, _bare(F.when(other, text))).otherwise(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), _WORD), lambda t: t != "")


def postings(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(bucket, term, class, key, length, at): where each term stands in a row. All ``columns`` count; no phrase spans two of them.

    ``length`` is the row's number of terms, ``class`` its size in quarters of an octave.
    """
    words = [F.array_append(tokens(F.col(c)), F.lit("")) for c in columns]  # the blank term keeps columns apart
    rows = rows.select(*key, F.flatten(F.array(*words)).alias("_w")).withColumn("length", F.size("_w") - len(columns))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key, "length").schema)
    found = rows.select(*key, "length", "_w").mapInArrow(_gather, f"{kinds}, term string, at array<int>")
    return found.select(*key, "term", "length", "at", bucket_of(F.col("term")).alias("bucket"), class_of(F.col("length")).alias("class"))


def _gather(batches):
    """Rows whose last column is a list of words to rows of (..., word, its places), some hundred at a time; no shuffle is needed."""
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            words = batch.column(batch.num_columns - 1)
            ends = words.offsets.to_numpy()
            row, coded = np.repeat(np.arange(len(words)), np.diff(ends)), words.flatten().dictionary_encode()
            at, code = np.arange(len(row)) - (ends[:-1] - ends[0])[row], coded.indices.to_numpy()
            blank = coded.dictionary.index("").as_py()
            row, at, code = (x[code != blank] for x in (row, at, code))
            order = np.argsort(row * (len(coded.dictionary) + 1) + code, kind="stable")
            row, at, code = row[order], at[order], code[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.array([], dtype=int)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype("int32")), pa.array(at.astype("int32")))
            own = [batch.column(k).take(pa.array(row[first])) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, coded.dictionary.take(pa.array(code[first])), places], names=[*batch.schema.names[:-1], "term", "at"])


def class_of(length: Column) -> Column:
    return F.floor(F.log2(length) * 4).cast("int")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), term), F.lit(BUCKETS)).cast("int")


def gain(f: Column, length: Column, mean: Column | float) -> Column:
    """What a row with ``f`` occurrences adds to a score, but for the term's weight."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def weight(n: Column | int, d: Column | int) -> Column:
    """Of a term that ``d`` of ``n`` rows have."""
    idf = F.log((F.lit(n) - d + 0.5) / (d + F.lit(0.5)))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def write_postings(rows: DataFrame, path: str, key: list[str], columns: list[str], block_rows: int = 4096) -> None:
    """Store postings by bucket, sorted by term and block, a table of blocks, and one row of totals.

    ``key`` names a row. Blocks have about ``block_rows`` documents, and a hot term's rows are written by as many tasks as
    it has blocks, so no task holds all of them. Postings lie on disk once while they are sorted, and once as stored: lengths
    are counted ahead, by a split of the texts of its own.
    """
    spark = rows.sparkSession
    length = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    sizes = rows.select(length.alias("length")).groupBy(class_of(F.col("length")).alias("class")).agg(F.count("*").alias("m"), F.sum("length").alias("total")).collect()  # a row a class, some hundred at most
    n, total = sum(r["m"] for r in sizes), sum(r["total"] for r in sizes)
    spark.createDataFrame([(n, total)], "n long, total long").write.mode("overwrite").parquet(f"{path}/totals")
    sizes = [r for r in sizes if r["class"] is not None]
    parts = F.create_map(*[x for r in sizes for x in (F.lit(r["class"]), F.lit(-(-r["m"] // block_rows)))])[F.col("class")] if sizes else F.lit(1)
    placed = postings(rows, key, columns).withColumn("part", F.pmod(F.xxhash64(F.lit(11), *key), parts).cast("int"))
    schema = placed.schema
    placed = placed.repartition("bucket", "term", "class", "part").sortWithinPartitions("bucket", "term", "class", "part")
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the sorted rows' shuffle files go once they are stored
    was = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        placed.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    finally:
        spark.conf.unset(clean) if was is None else spark.conf.set(clean, was)
    best = F.max(gain(F.size("at"), F.col("length"), total / n if n else 1.0)).alias("best")
    blocks = spark.read.schema(schema).parquet(f"{path}/terms").groupBy("bucket", "term", "class", "part").agg(F.count("*").alias("rows"), best)
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/blocks")


def phrases_of(query: str) -> list[list[str]]:
    """Words of a query as phrases: what isn't a letter, digit, _ or - is dropped, what - or _ joins must stand together."""
    words = (re.sub(r"[^A-Za-z0-9_-]", "", w) for w in re.sub(r"['\"]", "", query).split())
    found = ([t for t in re.split(r"[^a-z0-9]+", w.lower()) if t] for w in words if 0 < len(w) < 100)
    return [list(p) for p in dict.fromkeys(tuple(p) for p in found if p)]


def moved(at: Column, back: int) -> Column:
    return F.transform(at, lambda x: x - back)


def own_rows(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The rows of ``terms``, pruned to their buckets."""
    stored = spark.read.parquet(path)
    if not terms:
        return stored.where("false")
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t")).alias("b")).distinct().collect()]
    return stored.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def scored(hits: DataFrame, phrases: list[list[str]], key: list[str], facts: tuple[int, int], known: dict[str, int] | None) -> DataFrame:
    """(key, score) of the rows with every phrase. ``known``: how many rows have each term, where all phrases are one term;
    else it is counted over ``hits``."""
    terms, (n, total) = sorted({t for p in phrases for t in p}), facts
    at = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"_t{i}") for i, t in enumerate(terms)]
    rows = hits.groupBy(*key).agg(F.first("length").alias("_len"), *at) if terms else hits.select(*key, F.col("length").alias("_len"))
    place = {t: f"_t{i}" for i, t in enumerate(terms)}

    def count(phrase: list[str]) -> Column:
        starts = F.col(place[phrase[0]])
        for k, t in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, moved(F.col(place[t]), k))
        return F.coalesce(F.greatest(F.size(starts), F.lit(0)), F.lit(0))

    rows = rows.select(*key, "_len", *[count(p).alias(f"_f{i}") for i, p in enumerate(phrases)])
    if known is None:
        with_phrase = rows.agg(F.lit(1).alias("_one"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(phrases))])
        rows = rows.crossJoin(F.broadcast(with_phrase))  # one row
    else:
        rows = rows.withColumns({f"_d{i}": F.lit(known[p[0]]) for i, p in enumerate(phrases)})
    both = rows.where(" and ".join(f"_f{i} > 0" for i in range(len(phrases))) or "false")
    part = lambda i: weight(n, F.col(f"_d{i}")) * gain(F.col(f"_f{i}"), F.col("_len"), total / n if n else 1.0)
    return both.select(*key, sum((part(i) for i in range(len(phrases))), F.lit(0.0)).alias("score"))


def search_postings(spark: SparkSession, path: str, query: str, key: list[str], cohort: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """(key, score): rows with every phrase, by BM25 over all rows; ``cohort`` (key) keeps some of them. Ties by key."""
    return search_blocks(spark, path, query, key, cohort, limit)[0]


def search_blocks(spark: SparkSession, path: str, query: str, key: list[str], cohort: DataFrame | None = None, limit: int | None = 10, first: int = 8) -> tuple[DataFrame, dict]:
    """``search_postings``, and what it read: {rows: of the query's terms, read: of them, blocks: with all terms, read_blocks}.

    The ``first`` most promising blocks are read first, then eight times as many at a time until ``limit`` rows are found
    or blocks run out, then all that can still reach the last place: the result is exact. Queries with phrases of
    several words, or without a limit, read all blocks.
    """
    phrases = phrases_of(query)
    terms = sorted({t for p in phrases for t in p})
    got = spark.read.parquet(f"{path}/totals").first()
    facts, order = (got["n"], got["total"]), [F.desc("score"), *key]
    hits = own_rows(spark, f"{path}/terms", terms)
    kept = lambda df: df if cohort is None else df.join(cohort.select(*key).distinct(), key, "left_semi")
    blocks = own_rows(spark, f"{path}/blocks", terms)
    sums = {r["term"]: r["d"] for r in blocks.groupBy("term").agg(F.sum("rows").alias("d")).collect()}  # a row a term of the query
    report = {"rows": sum(sums.values()), "read": sum(sums.values()), "blocks": None, "read_blocks": None}
    if limit is None or not terms or len(phrases) != len(terms) or len(sums) < len(terms):
        out = kept(scored(hits, phrases, key, facts, None)).orderBy(*order)
        return (out.limit(limit) if limit else out), report

    best = sum((F.when(F.col("term") == t, weight(facts[0], F.lit(sums[t])) * F.col("best")).otherwise(0.0) for t in terms), F.lit(0.0))
    able = blocks.groupBy("class", "part").agg(F.count("*").alias("m"), F.sum(best).alias("most"), F.sum("rows").alias("rows")).where(F.col("m") == len(terms))
    able = stage(able.select("class", "part", "most", "rows"), "postings-blocks")
    turn = F.row_number().over(Window.orderBy(F.desc("most"), "class", "part"))  # a row a block of some thousand documents
    able = stage(able.withColumn("turn", turn), "postings-turns")
    report |= {"blocks": able.count(), "read": 0, "read_blocks": 0}

    def read(some: DataFrame) -> DataFrame:
        """The best rows of some blocks, at most ``limit``."""
        counts = some.agg(F.count("*").alias("b"), F.sum("rows").alias("r"), F.collect_set("class").alias("c")).first()
        report["read"] += counts["r"] or 0
        report["read_blocks"] += counts["b"]
        own = hits.where(F.col("class").isin(counts["c"])).join(some.select("class", "part"), ["class", "part"], "left_semi")
        return stage(kept(scored(own, phrases, key, facts, sums)).orderBy(*order).limit(limit), "postings-best")

    out, at, step = read(able.where(F.col("turn") <= first)), first, first
    while at < report["blocks"] and out.count() < limit:
        step *= 8
        out = stage(out.unionByName(read(able.where((F.col("turn") > at) & (F.col("turn") <= at + step)))).orderBy(*order).limit(limit), "postings-best")
        at += step
    least = out.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    left = able.where(F.col("turn") > at)
    left = left.where(F.col("most") >= least["s"] - 1e-9) if least["n"] >= limit else left
    if left.limit(1).count():
        out = out.unionByName(read(left))
    return out.orderBy(*order).limit(limit), report
