"""64-bit vote counting with built-in functions only.

The hash of each term is exploded to a row, and 32 sums count all 64 bits: sum j adds bit j in its low half and bit
j + 32 in its high half. A text has fewer than 2^30 terms, so a half never overflows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HALVES = (1 << 32) | 1


def vote_sums(h: str | Column, weight: Column | None = None) -> list[Column]:
    """Aggregates v0 ... v31 over rows of one term hash each."""
    h = F.col(h) if isinstance(h, str) else h
    bits = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(HALVES)) for j in range(32)]
    return [F.sum(b if weight is None else b * weight).alias(f"v{j}") for j, b in enumerate(bits)]


def majority(total: str | Column, prefix: str = "v") -> Column:
    """The 64-bit number whose bits have over half of ``total``; zero where there are no terms."""
    total = F.col(total) if isinstance(total, str) else total
    low = lambda j: F.col(f"{prefix}{j}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda j: F.shiftrightunsigned(F.col(f"{prefix}{j}"), 32)
    signed = lambda b: (1 << b) - (1 << 64 if b == 63 else 0)
    bits = [F.when((low(b) if b < 32 else high(b - 32)) * 2 > total, F.lit(signed(b))).otherwise(F.lit(0)) for b in range(64)]
    while len(bits) > 1:
        bits = [reduce(lambda x, y: x.bitwiseOR(y), bits[i : i + 2]) for i in range(0, len(bits), 2)]
    return bits[0].cast("long")


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
