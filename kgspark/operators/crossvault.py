"""Operators across vaults: candidates for missing links, validated note URIs, the declared overlay graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.links import wikilinks
from kgspark.functions.notes import with_path_parts
from kgspark.functions.uris import canonical, parse


def candidates(notes: DataFrame, most: int = 50) -> DataFrame:
    """(vault, path, target, n_targets, targets): links whose name no note of their own vault has, but one of another has.

    Names compare without case; the part before the last slash is ignored. Notes are grouped by name before the join, so
    a link meets one row however common its name is: the number of notes and the first ``most`` of them by vault and
    path. ``targets_of`` gives all notes of a name.
    """
    files = targets_of(notes)
    links = wikilinks(notes, "raw").select("vault", "path", "target", F.lower(F.element_at(F.split("target", "/"), -1)).alias("key"))
    first = Window.partitionBy("key").orderBy("vault", "path")  # a limit on the rank is taken ahead of the shuffle too
    some = files.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("vault", "path"))).alias("targets"))
    named = files.groupBy("key").agg(F.count("*").alias("n_targets")).join(some, "key")
    rows = links.join(files.select("vault", "key").distinct(), ["vault", "key"], "left_anti").join(named, "key")
    return rows.select("vault", "path", "target", "n_targets", "targets")


def targets_of(notes: DataFrame) -> DataFrame:
    """(vault, path, key): every note under the name that links call it by."""
    return with_path_parts(notes.select("vault", "path")).select("vault", "path", F.lower("name").alias("key"))


def validate(uris: DataFrame, files: DataFrame, vaults: DataFrame) -> DataFrame:
    """Add status, relationship, to_vault, to_path to (vault, path, uri) rows.

    A URI's vault is looked up without case: none, one or several names decide the status; its file must exist exactly.
    ``vaults`` has the configured names (few), ``files`` all notes.
    """
    rows = parse(uris)
    named = vaults.groupBy(F.lower("vault").alias("_k")).agg(F.count("*").alias("_n"), F.min("vault").alias("to_vault"))
    rows = rows.join(F.broadcast(named), F.lower("uri_vault") == F.col("_k"), "left").drop("_k")
    full = F.when(F.lower("uri_file").endswith(".md"), F.col("uri_file")).otherwise(F.concat("uri_file", F.lit(".md")))
    rows = rows.withColumn("to_path", full)
    there = files.select(F.col("vault").alias("_v"), F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, (F.col("to_vault") == F.col("_v")) & (F.col("to_path") == F.col("_p")), "left").drop("_v", "_p")
    status = (
        F.when(F.col("parser_status").isNotNull(), F.col("parser_status")).when(F.col("_n").isNull(), "unknown_vault").when(F.col("_n") > 1, "ambiguous_vault")
        .when(F.col("_there").isNull(), "missing_destination").when(F.col("to_vault") == F.col("vault"), "same_vault_reference").when(F.col("noncanonical"), "noncanonical").otherwise("valid")
    )
    return rows.withColumns({"status": status, "relationship": F.when(F.col("to_vault") != F.col("vault"), "cross_vault").otherwise("same_vault")}).drop("_n", "_there")


def overlay(checked: DataFrame, most_subpaths: int | None = 20) -> DataFrame:
    """One row an edge, with up to ``most_subpaths`` subpaths (all with None) and their whole number: vault, path, to_vault, to_path, total, canonical, noncanonical, subpaths (value and count), canonical_uri."""
    rows = checked.where(F.col("status").isin("valid", "noncanonical") & (F.col("relationship") == "cross_vault"))
    keys = ["vault", "path", "to_vault", "to_path"]
    odd = F.count(F.when(F.col("status") == "noncanonical", 1))
    by_sub = rows.groupBy(*keys, F.coalesce("subpath", F.lit("")).alias("subpath")).agg(F.count("*").alias("count"), odd.alias("odd"))
    place = Window.partitionBy(*keys).orderBy("subpath")
    by_sub = by_sub.withColumn("_r", F.row_number().over(place))
    out = by_sub.groupBy(*keys).agg(
        F.sum("count").alias("total"),
        (F.sum("count") - F.sum("odd")).alias("canonical"),
        F.sum("odd").alias("noncanonical"),
        F.count("*").alias("unique_subpaths"),
        F.array_sort(F.collect_list(F.when(F.lit(True) if most_subpaths is None else F.col("_r") <= most_subpaths, F.struct("subpath", "count")))).alias("subpaths"),
    )
    return out.withColumn("canonical_uri", canonical(F.col("to_vault"), F.col("to_path"), F.lit(None).cast("string")))


def excluded(checked: DataFrame) -> DataFrame:
    """(status, n) of the declarations that make no edge."""
    rows = checked.where(~(F.col("status").isin("valid", "noncanonical") & (F.col("relationship") == "cross_vault")))
    return rows.groupBy("status").agg(F.count("*").alias("n"))
