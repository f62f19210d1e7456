"""Collection health: orphans in their several meanings, broken links, stale notes, dead ends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.links import link_places, wikilinks
from kgspark.functions.notes import with_path_parts
from kgspark.operators.links import resolve


def orphans(notes: DataFrame, links: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(vault, path) that no link resolves to; the target is resolved with its subpath, and links to oneself count."""
    hit = links.where("dst is not null").select("vault", F.col("dst").alias("path")).distinct()
    rows = notes.select("vault", "path").join(hit, ["vault", "path"], "left_anti")
    for prefix in skip:
        rows = rows.where(~F.col("path").startswith(prefix))
    return rows


def orphans_below_root(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Orphans that aren't at the top of their vault."""
    return orphans(notes, links).where(F.contains("path", F.lit("/")))


def orphans_by_name(notes: DataFrame) -> DataFrame:
    """(vault, path) whose name and whose path without .md no link spells, case and all; subpaths are dropped, nothing is resolved."""
    spelled = wikilinks(notes, "raw").select("vault", F.substring_index("link_path", "^", 1).alias("spelled")).distinct()
    files = with_path_parts(notes.select("vault", "path")).withColumn("bare", F.regexp_replace("path", r"\.md$", ""))
    by_name = files.join(spelled.withColumnRenamed("spelled", "name"), ["vault", "name"], "left_anti")
    return by_name.join(spelled.withColumnRenamed("spelled", "bare"), ["vault", "bare"], "left_anti").select("vault", "path")


def dead_ends(notes: DataFrame) -> DataFrame:
    """(vault, path) of notes without any link."""
    return notes.where(~F.col("raw").rlike(r"\[\[[^\]]+\]\]")).select("vault", "path")


def unresolved_names(notes: DataFrame) -> DataFrame:
    """(vault, path, target) of links that spell neither a note's name nor its path; case matters, nothing is resolved."""
    files = with_path_parts(notes.select("vault", "path"))
    known = files.select("vault", F.col("name").alias("link_path"))
    known = known.unionByName(files.select("vault", F.col("path").alias("link_path"))).unionByName(files.select("vault", F.regexp_replace("path", r"\.md$", "").alias("link_path")))
    return wikilinks(notes, "raw").join(known.distinct(), ["vault", "link_path"], "left_anti").select("vault", "path", F.col("link_path").alias("target"))


def broken_places(notes: DataFrame, column: str = "raw") -> DataFrame:
    """(vault, path, line_no, col, index_on_line, target) of each link that resolves nowhere, its subpath kept in the name."""
    places = link_places(notes, column)
    inner = F.regexp_extract("match", r"\[\[([^\]|]+)", 1)
    places = places.withColumn("target", F.trim(F.regexp_replace(inner, r"^([a-zA-Z][\w-]*):", "")))
    return resolve(places, notes, "target").where("dst is null").select("vault", "path", "line_no", "col", "index_on_line", "target")


def stale(notes: DataFrame, as_of: dt.datetime, days: int = 90, kind: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(vault, path, days): notes not changed for ``days`` days before ``as_of``, the oldest first, then by path; ``kind``
    compares the type field without case."""
    at = F.lit(as_of).cast("timestamp")
    age = F.floor((F.unix_millis(at) - F.unix_millis(F.col("mtime").cast("timestamp"))) / 86_400_000)
    rows = notes.where(F.unix_millis(F.col("mtime").cast("timestamp")) < F.unix_millis(at) - days * 86_400_000)
    if kind is not None:
        rows = rows.where(F.lower(F.try_variant_get("props", "$.type", "string")) == kind.lower())
    for prefix in skip:
        rows = rows.where(~F.col("path").startswith(prefix))
    return rows.select("vault", "path", age.cast("long").alias("days")).orderBy(F.desc("days"), "path")


def vault_health(notes: DataFrame, links: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """One row a vault: notes, orphans (below the root), broken_links, broken_targets, stale_notes."""
    count = lambda df, name: df.groupBy("vault").agg(F.count("*").alias(name))
    rows = count(notes, "notes").join(count(orphans_below_root(notes, links), "orphans"), "vault", "left")
    missing = links.where("dst is null").groupBy("vault").agg(F.count("*").alias("broken_links"), F.count_distinct("target").alias("broken_targets"))
    return rows.join(missing, "vault", "left").join(count(stale(notes, as_of, days), "stale_notes"), "vault", "left").fillna(0)
