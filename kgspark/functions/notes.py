"""Note text as columns: metadata, body, title, headings, tasks, tags."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgspark.functions.jslike import WS, elements, field, is_array, js_string, trim

#: Fixed value: the form of a metadata block.
FRONT = r"(?s)^---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|$)"


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, float) and value != value:
        return None
    return value


def parse_front(text: str | None) -> str:
    """JSON object of a metadata block; ``{}`` for none or for one that isn't a mapping."""
    if not text or not text.strip():
        return "{}"
    try:
        import yaml
    except ImportError:
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and line[:1].strip())
        return json.dumps({k.strip(): v.strip() for k, v in pairs})
    try:
        value = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return "{}"
    return json.dumps(_plain(value), ensure_ascii=False) if isinstance(value, dict) else "{}"


@F.pandas_udf(StringType())
def front_to_json(s: pd.Series) -> pd.Series:
    return s.map(parse_front)


def split_front(raw: str = "raw") -> tuple[Column, Column]:
    """(metadata text, trimmed body)."""
    return F.regexp_extract(raw, FRONT, 1), trim(F.regexp_replace(raw, FRONT, ""))


def with_path_parts(df: DataFrame) -> DataFrame:
    """Add name (without .md), dir and depth."""
    base = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"name": F.regexp_replace(base, r"(?i)\.md$", ""), "dir": F.regexp_replace("path", "/?[^/]*$", ""), "depth": F.size(F.split("path", "/"))})


def parse_notes(df: DataFrame) -> DataFrame:
    """Add name, dir, depth, body, props (VARIANT) and title to (vault, path, raw, ...). Parse once, then persist."""
    front, body = split_front()
    out = with_path_parts(df).withColumn("body", body).withColumn("props", F.parse_json(front_to_json(front)))
    return out.withColumn("title", title())


def title(body: str = "body", props: str = "props", name: str = "name") -> Column:
    """Text-valued title field, else the first level-1 heading, else the name."""
    v = field(F.col(props), "title")
    own = F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.variant_get(v, "$", "string"), F.lit("")))
    head = F.nullif(trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return F.coalesce(own, head, F.col(name))


def sections(df: DataFrame, column: str = "raw", *keep: str) -> DataFrame:
    """(keep, block_id, heading, level, start_line, content): each heading's own lines, up to the next heading.

    Text of over 50 characters ahead of the first heading is a section of level 0. Ids are the headings' slugs, numbered
    where they come again.
    """
    keep = keep or ("vault", "path")
    own = lines(df, column, *keep)
    head = F.col("line").rlike(r"^#{1,6}\s+.+$")
    own = own.withColumn("_head", head).withColumn("_k", F.sum(head.cast("int")).over(Window.partitionBy(*keep).orderBy("line_no")))
    text = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line_no", "line"))))
    rows = own.groupBy(*keep, "_k").agg(F.min_by("line", "line_no").alias("heading"), F.min("line_no").alias("start_line"), trim(F.array_join(F.transform(text, lambda x: x["line"]), "\n")).alias("content"))
    rows = rows.where((F.col("_k") > 0) | (F.length("content") > 50))
    slug = F.lower(trim(F.regexp_replace("heading", r"^#{1,6}\s+", "")))
    for pattern, by in ((r"[^a-zA-Z0-9_\s-]", ""), (r"\s+", "-"), ("-+", "-")):
        slug = F.regexp_replace(slug, pattern, by)
    rows = rows.withColumn("_slug", F.when(F.col("_k") > 0, slug).otherwise("_preamble"))
    again = F.row_number().over(Window.partitionBy(*keep, "_slug").orderBy("start_line"))
    block = F.when(again > 1, F.concat("_slug", F.lit("-"), again.cast("string"))).otherwise(F.col("_slug"))
    level = F.when(F.col("_k") > 0, F.length(F.regexp_extract("heading", "^#+", 0))).otherwise(0)
    return rows.select(*keep, block.alias("block_id"), F.when(F.col("_k") > 0, F.col("heading")).otherwise("").alias("heading"), level.alias("level"), "start_line", "content")


def lines(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row a line: ``keep``, line_no (from 1), line."""
    out = df.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    return out.withColumn("line_no", F.col("line_no") + 1)


def tasks(notes: DataFrame) -> DataFrame:
    """(vault, path, line_no, mark, done, task) of checkbox lines with - or * bullets."""
    pattern = r"^(\s*[-*]\s+)\[(.)\]\s+(.*)"
    rows = lines(notes, "raw", "vault", "path").where(F.col("line").rlike(pattern))
    mark = F.regexp_extract("line", pattern, 2)
    return rows.select("vault", "path", "line_no", mark.alias("mark"), F.lower(mark).eqNullSafe("x").alias("done"), F.regexp_extract("line", pattern, 3).alias("task"))


def outline(notes: DataFrame) -> DataFrame:
    """(vault, path, line_no, level, heading, shown): headings of the raw text, indented two spaces a level."""
    rows = lines(notes, "raw", "vault", "path").where(F.col("line").rlike(r"^#{1,6}\s+.+"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)
    return rows.select("vault", "path", "line_no", level.alias("level"), heading.alias("heading"), F.concat(F.expr("repeat('  ', length(regexp_extract(line, '^(#{1,6})', 1)) - 1)"), heading).alias("shown"))


def text_list(v: Column) -> Column:
    """Texts of a metadata value: its elements if it is a list, itself if not, none if absent or null."""
    many = F.transform(F.filter(elements(v), lambda e: ~F.is_variant_null(e)), js_string)
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<string>")).when(is_array(v), many).otherwise(F.array(js_string(v)))


def tags(notes: DataFrame) -> DataFrame:
    """(vault, path, tag, origin): occurrences in the metadata's tags field and inline in the whole raw text."""
    own = notes.select("vault", "path", F.explode(text_list(field(F.col("props"), "tags"))).alias("tag"), F.lit("metadata").alias("origin"))
    inline = F.regexp_extract_all("raw", F.lit(rf"(?:^|[{WS}])#([a-zA-Z][a-zA-Z0-9_/-]*)"), F.lit(1))
    return own.unionByName(notes.select("vault", "path", F.explode(inline).alias("tag"), F.lit("inline").alias("origin")))


def properties(notes: DataFrame) -> DataFrame:
    """(vault, path, key, value VARIANT): top-level metadata entries."""
    rows = notes.select("vault", "path", F.explode(F.json_object_keys(F.to_json("props"))).alias("key"), "props")
    return rows.select("vault", "path", "key", F.expr("try_variant_get(props, concat('$[\"', key, '\"]'), 'variant')").alias("value"))


def word_counts(notes: DataFrame) -> DataFrame:
    """(vault, path, words, characters) of the body; characters are UTF-16 units."""
    from kgspark.functions.jslike import utf16_length

    return notes.select("vault", "path", F.regexp_count("body", F.lit(f"[^{WS}]+")).cast("long").alias("words"), utf16_length(F.col("body")).cast("long").alias("characters"))
