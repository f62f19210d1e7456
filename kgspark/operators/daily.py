"""Daily notes and picks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators.edits import append, prepend

#: Tokens of a daily-note format, longest first, and Spark's patterns.
TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss"))


def daily_path(at: Column, folder: str = "", pattern: str = "YYYY-MM-DD") -> Column:
    """Path of the note of a day; each token is replaced where it first stands."""
    out = F.lit(pattern)
    for token, spark_pattern in TOKENS:
        cut = F.locate(token, out)
        out = F.when(cut > 0, F.overlay(out, F.date_format(at, spark_pattern), cut, F.lit(len(token)))).otherwise(out)
    return F.concat(F.lit(folder.strip("/") + "/" if folder.strip("/") else ""), out, F.lit(".md"))


def daily_note(notes: DataFrame, as_of: dt.datetime, folder: str = "", pattern: str = "YYYY-MM-DD") -> DataFrame:
    return notes.where(F.col("path") == daily_path(F.lit(as_of), folder, pattern))


def daily_add(notes: DataFrame, as_of: dt.datetime, content: str, vault: str, where: str = "append", folder: str = "", pattern: str = "YYYY-MM-DD") -> DataFrame:
    """Notes with ``content`` at the end (``append``) of the day's note or behind its metadata (``prepend``); the note is made if it isn't there."""
    at = notes.sparkSession.range(1).select(daily_path(F.lit(as_of), folder, pattern).alias("p")).first()["p"]
    mine = (F.col("vault") == vault) & (F.col("path") == at)
    if not notes.where(mine).limit(1).count():
        row = notes.sparkSession.createDataFrame([(vault, at, "")], "vault string, path string, raw string")
        notes = notes.unionByName(row, allowMissingColumns=True)
    new = append("raw", content) if where == "append" else prepend("raw", content)
    return notes.withColumn("raw", F.when(mine, new).otherwise(F.col("raw")))


def random_note(notes: DataFrame, seed: int, folder: str | None = None) -> DataFrame:
    """One note, by seeded hash: the same seed picks the same note. A top-1, not a sort."""
    rows = notes.where(F.col("path").startswith(folder.strip("/") + "/")) if folder else notes
    return rows.orderBy(F.md5(F.concat("path", F.lit(f"#{seed}"))), "path").limit(1)
