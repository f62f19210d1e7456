"""Loosely typed string and number semantics as Column expressions.

Metadata values are dynamic: comparing them goes through text forms (``undefined`` for a missing field, ``null``,
``true``, arrays joined by commas) and through a lenient number reading.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of the source semantics, wider than Java's ``\\s``.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the base plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def field(props: Column, name: str) -> Column:
    return F.variant_get(props, f'$["{name}"]' if not name.replace("_", "").isalnum() else f"$.{name}", "variant")


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _scalar(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.is_variant_null(v), "null").otherwise(F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"))


def js_string(v: Column) -> Column:
    """Text form of a metadata value."""
    joined = F.array_join(F.transform(elements(v), lambda e: F.coalesce(F.when(~F.is_variant_null(e), _scalar(e)), F.lit(""))), ",")
    return F.when(v.isNull(), "undefined").when(is_array(v), joined).otherwise(_scalar(v))


def number_text(s: Column) -> Column:
    """Number that a text reads as, null for none: blank is 0, hexadecimal counts, surrounding space doesn't."""
    t = trim(s)
    hexed = F.conv(F.substring(t, 3, 20), 16, 10).cast("double")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), hexed).otherwise(plain)


def js_number(v: Column) -> Column:
    s = js_string(v)
    return F.when(s == "true", F.lit(1.0)).when(s == "false", F.lit(0.0)).otherwise(number_text(s))


def round_half_up(c: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(c: str | Column) -> Column:
    """Composed form; only texts beyond ASCII leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfc(F.when(other, c))).otherwise(c)
