"""Schemaless predicates over note metadata, compiled to Columns: they never fall into SQL's third truth value."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.jslike import elements, field, is_array, js_number, js_string, number_text


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


def _text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return ",".join(map(_text, value)) if isinstance(value, (list, tuple)) else str(value)


def _same(element: Column, value: Any) -> Column:
    """Equal in type and value, case and all."""
    kind, text = F.schema_of_variant(element), F.try_variant_get(element, "$", "string")
    if isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (text == str(value).lower())
    elif isinstance(value, (int, float)):
        hit = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (F.try_variant_get(element, "$", "double") == float(value))
    else:
        hit = (kind == "STRING") & (text == F.lit(_text(value)))
    return F.coalesce(hit, F.lit(False))


def condition(c: Condition, props: str = "props") -> Column:
    v = field(F.col(props), c.field)
    there = v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))
    own, value = js_string(v), _text(c.value)
    match c.op:
        case "exists":
            return there
        case "not_exists":
            return ~there
        case "equals":
            inside = F.coalesce(F.exists(elements(v), lambda e: _same(e, c.value)), F.lit(False))
            return F.when(is_array(v), inside).otherwise(F.lower(own) == value.lower())
        case "not_equals":
            return ~condition(Condition(c.field, "equals", c.value), props)
        case "contains":
            word = F.lit(value.lower())
            inside = F.coalesce(F.exists(elements(v), lambda e: F.contains(F.lower(js_string(e)), word)), F.lit(False))
            falsy = ~there | own.isin("false", "0", "")
            return F.when(is_array(v), inside).otherwise(F.contains(F.lower(F.when(falsy, "").otherwise(own)), word))
        case "not_contains":
            return ~condition(Condition(c.field, "contains", c.value), props)
        case "in":
            wanted = c.value if isinstance(c.value, (list, tuple)) else [c.value]
            return F.lower(own).isin([_text(x).lower() for x in wanted])
        case "not_in":
            return ~condition(Condition(c.field, "in", c.value), props)
        case "greater_than" | "less_than":
            a, b = js_number(v), number_text(F.lit(value))
            up = c.op == "greater_than"
            numbers, texts = (a > b, own > value) if up else (a < b, own < value)
            return F.when(~there, F.lit(False)).otherwise(F.coalesce(numbers, texts))
        case _:
            return F.lit(True)


def all_of(conditions: Iterable[Condition], props: str = "props") -> Column:
    return reduce(lambda a, b: a & b, (condition(c, props) for c in conditions), F.lit(True))


def any_of(conditions: Iterable[Condition], props: str = "props") -> Column:
    return reduce(lambda a, b: a | b, (condition(c, props) for c in conditions), F.lit(False))


def query_notes(notes: DataFrame, where: Iterable[Condition] = (), start: str | None = None, fields: Iterable[str] = (), sort_by: str | None = None, limit: int | None = 50) -> DataFrame:
    """Filter, project, sort and cut parsed notes: (vault, path, one text column a field).

    ``start`` keeps one folder's notes. ``sort_by`` (``-`` ahead for descending) compares texts by collation and only
    sees projected fields; ties fall to the path. Without ``fields`` the metadata comes whole, as JSON.
    """
    rows = notes.where(all_of(where))
    if start:
        rows = rows.where(F.col("path").startswith(start.strip("/") + "/"))
    fields = list(fields)
    present = lambda f: F.when(field(F.col("props"), f).isNotNull(), js_string(field(F.col("props"), f)))
    shown = [present(f).alias(f) for f in fields] or [F.to_json("props").alias("props")]
    key, down = (sort_by or "").lstrip("-"), (sort_by or "").startswith("-")
    if key and (not fields or key in fields):
        text = F.collate(F.coalesce(present(key), F.lit("")), "UNICODE")
        order = [text.desc() if down else text.asc(), F.col("path")]
    else:
        order = [F.col("path")]
    rows = rows.orderBy(*order)
    return (rows.limit(limit) if limit else rows).select("vault", "path", *shown)
