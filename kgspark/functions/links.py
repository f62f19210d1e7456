"""Links of note text as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.jslike import WS, trim

#: Fixed value: the form of a link.
LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"


def wikilinks(notes: DataFrame, column: str = "body", keep: tuple[str, ...] = ("vault", "path")) -> DataFrame:
    """One row a link: ``keep``, ord (from 0), match (as written), is_embed, raw_target, alias, link_vault, target, link_path, subpath.

    ``target`` keeps the part behind #, ``link_path`` drops it. A vault prefix is a word without spaces and a colon.
    """
    found = F.regexp_extract_all(column, F.lit(r"!?" + LINK), F.lit(0))
    out = notes.select(*keep, F.posexplode(found).alias("ord", "_m"))
    inner = trim(F.regexp_extract("_m", LINK, 1))
    prefix = r"^([a-zA-Z][\w-]*):"
    out = out.withColumns({
        "is_embed": F.col("_m").startswith("!"),
        "raw_target": inner,
        "alias": F.nullif(trim(F.regexp_extract("_m", LINK, 2)), F.lit("")),
        "link_vault": F.nullif(F.regexp_extract(inner, prefix, 1), F.lit("")),
        "target": trim(F.regexp_replace(inner, prefix, "")),
    })
    subpath = F.when(F.contains("target", F.lit("#")), F.expr("substring(target, locate('#', target) + 1)"))
    return out.withColumns({"link_path": F.substring_index("target", "#", 1), "subpath": subpath}).withColumnRenamed("_m", "match")


def unresolved_key(target: Column) -> Column:
    """Name under which a missing target is counted: without alias and subpath, trimmed."""
    return trim(F.substring_index(F.substring_index(target, "|", 1), "#", 1))


def link_places(notes: DataFrame, column: str = "body", keep: tuple[str, ...] = ("vault", "path")) -> DataFrame:
    """One row a link with its place: ``keep``, line_no, col (both from 1), index_on_line (from 0), match, line.

    Columns count characters before the match: the text between matches is what splitting by them leaves.
    """
    rows = notes.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("[[")))
    rows = rows.withColumn("_m", F.regexp_extract_all("line", F.lit(r"!?" + LINK), F.lit(0))).withColumn("_between", F.split("line", r"!?" + LINK, -1))
    rows = rows.select("*", F.posexplode("_m").alias("index_on_line", "match"))
    before = F.aggregate(F.slice("_between", 1, F.col("index_on_line") + 1), F.lit(0), lambda a, x: a + F.length(x))
    ahead = F.aggregate(F.slice("_m", 1, F.col("index_on_line")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select(*keep, (F.col("line_no") + 1).alias("line_no"), (before + ahead + 1).alias("col"), "index_on_line", "match", "line")


def context(text: Column, link: Column, width: int = 100) -> Column:
    """Up to ``width`` characters on either side of the first place of ``link``, white space collapsed, cut ends marked."""
    at = F.instr(text, link)
    start, end = F.greatest(at - width, F.lit(1)), F.least(at + F.length(link) + width, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at == 0, "").otherwise(trim(F.regexp_replace(cut, f"[{WS}]+", " ")))


def line_of(text: Column, link: Column) -> Column:
    """Number of the first line that holds ``link``, 0 if none does."""
    at = F.instr(text, link)
    return F.when(at == 0, 0).otherwise(F.size(F.split(F.substring(text, F.lit(1), at), "\n")))
