"""Text search over lines, names and keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.notes import lines, with_path_parts
from kgspark.functions.stem import stem, stem_terms

K1, B = 1.2, 0.75


def glob_regex(glob: str) -> str:
    """Anchored case-insensitive regex of a name pattern with * and ?."""
    return "(?i)^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def search_lines(notes: DataFrame, pattern: str, column: str = "raw", keep: tuple[str, ...] = ("vault", "path"), case: bool = False, per_vault: int | None = None) -> DataFrame:
    """``keep``, line_no, line (trimmed), matches: lines with a regex match and how many it has.

    ``per_vault`` caps the files of a vault, by path; the search is otherwise whole.
    """
    pattern = pattern if case else f"(?i){pattern}"
    rows = notes.where(F.col(column).rlike(pattern) if "^" not in pattern and "$" not in pattern else F.lit(True))
    if per_vault:
        files = rows.select(*keep).withColumn("_k", F.dense_rank().over(Window.partitionBy(keep[0]).orderBy(*keep[1:])))
        rows = rows.join(files.where(F.col("_k") <= per_vault).drop("_k"), list(keep), "left_semi")
    hits = lines(rows, column, *keep).where(F.col("line").rlike(pattern))
    return hits.select(*keep, "line_no", F.trim("line").alias("line"), F.regexp_count("line", F.lit(pattern)).alias("matches"))


def search_context(notes: DataFrame, text: str, column: str = "raw", keep: tuple[str, ...] = ("vault", "path"), case: bool = False, limit: int = 10) -> DataFrame:
    """``keep``, n, lines: matching trimmed lines of up to ``limit`` files in path order; the text is literal."""
    found = (lambda c: F.contains(c, F.lit(text))) if case else (lambda c: F.contains(F.lower(c), F.lit(text.lower())))
    files = notes.where(found(F.col(column))).orderBy(*keep).limit(limit)
    hits = lines(files, column, *keep).where(found(F.col("line")))
    grouped = hits.groupBy(*keep).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("l"))
    return grouped.select(*keep, "n", F.transform("l", lambda x: x["line"]).alias("lines"))


def find_by_name(notes: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """(vault, path, exact): notes whose name is or contains ``name``, without case; exact ones first, then by path."""
    low = name.lower()
    rows = with_path_parts(notes.select("vault", "path"))
    rows = rows.withColumn("exact", F.lower("name") == low).where(F.col("exact") if exact else F.contains(F.lower("name"), F.lit(low)))
    return rows.orderBy(F.desc("exact"), F.collate("path", "UNICODE"), "path").select("vault", "path", "exact")


def plain_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == F.lit(term)))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a keyword query: quotes and characters outside letters, digits, _ and - are dropped from words."""
    words = (re.sub(r"[^A-Za-z0-9_-]", "", w) for w in query.replace('"', "").split())
    terms = (t for w in words if 0 < len(w) < 100 for t in re.findall(r"[a-z0-9]+", w.lower()))
    return list(dict.fromkeys(terms))


def keyword_search(docs: DataFrame, query: str, key: str = "doc_id", column: str = "text", limit: int | None = 10, analyzer: str = "plain") -> DataFrame:
    """(key, score): documents with every term, by BM25; ties by key. ``analyzer`` is ``plain`` or ``porter`` (stems).

    Term counts are taken while scanning, only for the query's terms, so no postings are shuffled: corpus counts are
    one small aggregate, joined back to the matching rows.
    """
    terms = query_terms(query)
    words = plain_terms(F.coalesce(column, F.lit("")))
    if analyzer == "porter":
        terms, words = list(dict.fromkeys(map(stem, terms))), stem_terms(words)
    rows = docs.select(key, words.alias("_w"))
    rows = rows.select(key, F.size("_w").alias("_len"), *[_count("_w", x).alias(f"_f{i}") for i, x in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(terms))])
    both = rows.where(" and ".join(f"_f{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log((F.col("_n") - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    score = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    out = both.select(key, score.alias("score")).orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out
