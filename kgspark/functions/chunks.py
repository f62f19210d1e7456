"""Markdown to bounded chunks for embedding: lossless, sections first, then paragraphs, lines, words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)
CHUNKS = "block_id string, embedding_text string, source_text string, heading string, level int, start_line int, chunk_index int, chunk_count int"


def slug(text: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"\s", "-", re.sub(r"[^\w\s-]", "", text.lower()))).strip("-") or "section"


def sections(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, heading, level): each ends at the next heading of any level; blank text ahead joins the first."""
    found = list(HEADING.finditer(text))
    if not found:
        return [(0, len(text), "", 0)] if text else []
    out = []
    if text[: found[0].start()].strip():
        out.append((0, found[0].start(), "", 0))
    for i, m in enumerate(found):
        start = 0 if i == 0 and not out else m.start()
        out.append((start, found[i + 1].start() if i + 1 < len(found) else len(text), m[2], len(m[1])))
    return out


def cut_at(raw: bytes, at: int, end: int, limit: int) -> int:
    """Where a piece that starts at byte ``at`` ends: after at most ``limit`` bytes, back at a paragraph, line or blank if
    that is past half of its characters, never inside a character."""
    if end - at <= limit:
        return end
    to = at + limit
    while to > at and raw[to] & 0xC0 == 0x80:  # inside a character
        to -= 1
    if to == at:  # a character of more bytes than the limit
        return at + len(raw[at : at + 4].decode("utf-8", "ignore")[:1].encode())
    chars = len(raw[at:to].decode())
    for mark in (b"\n\n", b"\n", b" "):
        found = raw.rfind(mark, at, to)
        if found >= 0 and (len(raw[at:found].decode()) + len(mark)) * 2 >= chars:
            return found + len(mark)
    return to


def chunk(text: str, max_bytes: int = 2048) -> list[tuple]:
    """Rows of CHUNKS. Source texts joined give the text; no embedding text exceeds ``max_bytes``; ids are unique."""
    if max_bytes < 16:
        raise ValueError("max_bytes must be at least 16")
    rows, used, line_at, line = [], set(), 0, 1
    for start, end, heading, level in sections(text):
        base = slug(heading) if level else "preamble"
        name, k = base, 2
        while name in used:
            name, k = f"{base}-{k}", k + 1
        used.add(name)
        prefix = f"{'#' * level} {heading}\n\n" if level else ""
        prefix = prefix if len(prefix.encode()) * 2 <= max_bytes else ""
        raw, pieces, at = text[start:end].encode(), [], 0  # encoded once: a piece costs its own length
        while at < len(raw):
            to = cut_at(raw, at, len(raw), max_bytes - (len(prefix.encode()) if pieces else 0))
            pieces.append(raw[at:to].decode())
            at = to
        lo = start
        for i, own in enumerate(pieces):
            line += text.count("\n", line_at, lo)
            line_at, lo = lo, lo + len(own)
            unit = name if i == 0 else f"{name}~{i + 1}"
            rows.append((unit, own if i == 0 else prefix + own, own, heading, level, line, i + 1, len(pieces)))
    return rows


def chunk_texts(df: DataFrame, key: str, column: str = "text", max_bytes: int = 2048) -> DataFrame:
    """(key, CHUNKS, content_hash) of each text; nulls have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in CHUNKS.split(", ")), "content_hash"]
        for b in batches:
            rows = [(k, *r, hashlib.md5(r[1].encode()).hexdigest()) for k, t in zip(b[key], b[column]) if t for r in chunk(t, max_bytes)]
            yield pd.DataFrame(rows, columns=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {CHUNKS}, content_hash string")
