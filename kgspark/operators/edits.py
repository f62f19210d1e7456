"""Edits of notes as pure transforms of their raw text; a sink decides where the new version goes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgspark.functions.notes import FRONT, parse_front


def find_section(text: str, heading: str) -> tuple[int, int, int] | None:
    """(heading's start, content start, content end): to the next heading of the same or a higher level; case doesn't matter.

    ``heading`` may name its level by leading #.
    """
    m = re.match(r"^(#{1,6})\s+(.+)$", heading)
    level, name = (len(m[1]), m[2]) if m else (None, heading)
    marks = f"#{{{level}}}" if level else "#{1,6}"
    found = re.search(rf"^({marks})[ \t]+{re.escape(name.strip())}[ \t]*$\n?", text, re.M | re.I)
    if not found:
        return None
    rest = re.compile(rf"^#{{1,{len(found[1])}}}[ \t]+", re.M).search(text, found.end())
    return found.start(), found.end(), rest.start() if rest else len(text)


def edit_section(text: str, heading: str, content: str, how: str) -> str:
    """``append``, ``prepend`` or ``replace`` within a section; a text without it stays as it is."""
    at = find_section(text, heading)
    if at is None:
        return text
    _, start, end = at
    after = "\n" + text[end:] if text[end:] else ""
    if how == "append":
        return f"{text[:end].rstrip()}\n\n{content.strip()}\n{after}"
    if how == "prepend":
        return f"{text[:start]}{content.strip()}\n\n{text[start:].lstrip(chr(10))}"
    return f"{text[:start]}{content.strip()}\n{after}"


def section_column(column: str, heading: str, content: str, how: str) -> Column:
    """Only texts that spell the heading's words leave the JVM."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else edit_section(t, heading, content, how))

    words = re.sub(r"^#{1,6}\s+", "", heading).strip().lower()
    has = F.contains(F.lower(column), F.lit(words))
    return F.when(has, run(F.when(has, F.col(column)))).otherwise(F.col(column))


def front_text(values: dict) -> str:
    try:
        import yaml

        return yaml.safe_dump(values, sort_keys=False, allow_unicode=True).strip()
    except ImportError:
        return "\n".join(f"{k}: {v if isinstance(v, (int, float, str)) else json.dumps(v)}" for k, v in values.items())


def set_front(text: str, updates: dict, drop: tuple[str, ...] = ()) -> str:
    """Shallow merge of metadata; the body stays byte for byte."""
    m = re.match(FRONT, text)
    values = {k: v for k, v in (json.loads(parse_front(m[1] if m else None)) | updates).items() if k not in drop}
    body = text[m.end() :] if m else text
    return f"---\n{front_text(values)}\n---\n{body}" if values else body


def front_column(column: str | Column, updates: dict, drop: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else set_front(t, updates, drop))

    return run(column)


def toggle_task(column: str, line: int, action: str = "toggle") -> Column:
    """Set the checkbox on a line (from 1): ``done``, ``todo`` or the other state."""
    box = r"^(\s*[-*]\s+)\[(.)\]"

    def flip(x: Column, i: Column) -> Column:
        mark = F.regexp_extract(x, box, 2)
        new = {"done": F.lit("x"), "todo": F.lit(" ")}.get(action, F.when(F.lower(mark) == "x", " ").otherwise("x"))
        changed = F.concat(F.regexp_extract(x, box, 1), F.lit("["), new, F.lit("]"), F.regexp_replace(x, box, ""))
        return F.when((i == line - 1) & x.rlike(box), changed).otherwise(x)

    return F.array_join(F.transform(F.split(column, "\n"), flip), "\n")


def rewrite_links(column: str, old: str, new: str) -> Column:
    """Point links at a renamed note: targets that are the old name or path, with their subpath and alias kept."""
    quote = re.escape(old).replace("/", r"\/")
    return F.regexp_replace(column, rf"(?i)\[\[{quote}(?:\.md)?(#[^\]|]*)?(\|[^\]]*)?\]\]", f"[[{new}$1$2]]")


def rename_literal(column: str, old: str, new: str) -> Column:
    """The plainer rename: ``[[old]]`` and ``[[old|`` only, case and all."""
    return F.replace(F.replace(F.col(column), F.lit(f"[[{old}]]"), F.lit(f"[[{new}]]")), F.lit(f"[[{old}|"), F.lit(f"[[{new}|"))


def append(column: str, content: str) -> Column:
    return F.concat(column, F.lit("\n" + content))


def prepend(column: str, content: str) -> Column:
    """Behind the metadata block, if there is one."""
    front = F.regexp_extract(column, FRONT.replace("(?s)^", "(?s)^(").replace("(.*?)", ".*?") + ")", 1)
    return F.concat(front, F.lit(content + "\n"), F.regexp_replace(column, FRONT, ""))


def replace_text(column: str, search: str, by: str, every: bool = True) -> Column:
    if every:
        return F.replace(F.col(column), F.lit(search), F.lit(by))
    at = F.locate(search, F.col(column))
    return F.when(at > 0, F.overlay(F.col(column), F.lit(by), at, F.lit(len(search)))).otherwise(F.col(column))


def move(notes: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a note and rewrite the links to it if its name changed."""
    name = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md")
    rows = notes.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))
    return rows.withColumn("raw", rewrite_links("raw", name(old), name(new))) if name(old) != name(new) else rows


def replace_body(column: str, body: str, updates: dict | None = None) -> Column:
    """A new body under the metadata there is, which may be updated."""
    front = F.regexp_extract(column, FRONT.replace("(?s)^", "(?s)^(").replace("(.*?)", ".*?") + ")", 1)
    text = F.concat(front, F.lit(body))
    return front_column(text, updates) if updates else text


def create(notes: DataFrame, path: str, raw: str, vault: str) -> DataFrame:
    """Notes with one more; an existing path is a conflict."""
    if notes.where((F.col("vault") == vault) & (F.col("path") == path)).limit(1).count():
        raise FileExistsError(path)
    row = notes.sparkSession.createDataFrame([(vault, path, raw)], "vault string, path string, raw string")
    return notes.unionByName(row, allowMissingColumns=True)


def delete(notes: DataFrame, path: str) -> DataFrame:
    return notes.where(F.col("path") != path)
