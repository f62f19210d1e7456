"""Arrays over the code points of many texts at once: what the character models share."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Blocks of scripts by first and last code point.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0xF900, 0xFAFF),
    ("han", 0x20000, 0x3134F),
)
SCRIPT_NAMES = ("none", "other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@cache
def script_table() -> np.ndarray:
    """Script number of each code point: 0 for what isn't a letter, 1 for letters outside the ranges above."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    table[[c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]] = 1
    for name, first, last in SCRIPTS:
        part = table[first : last + 1]
        part[part > 0] = SCRIPT_NAMES.index(name)
    return table


@dataclass
class Chars:
    """Code points of texts laid end to end, each followed by a line feed; ``start`` has each text's first place and the end."""

    points: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Chars:
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32) if texts else np.zeros(0, np.uint32)
        return cls(points, np.concatenate([[0], np.cumsum(sizes)]))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text a place belongs to."""
        return np.searchsorted(self.start, at, side="right") - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one for each place) over each text."""
        if len(self.start) < 2:
            return np.zeros(0)
        return np.add.reduceat(values, self.start[:-1], dtype=np.float64)


def ngram_hashes(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place, a ``bits``-bit hash of the n code points that end there (fewer at the start)."""
    total = points * np.uint32(0x9E3779B1)
    for k in range(1, n):
        total[k:] += points[:-k] * np.uint32((0x85EBCA6B * (2 * k + 1)) & 0xFFFFFFFF)
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
    total ^= total >> np.uint32(13)
    total *= np.uint32(0x297A2D39)
    total >>= np.uint32(32 - bits)
    return total.view(np.int32)


def word_runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, places behind the last) of the runs of true in ``inside``."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs' code points, equal for equal runs."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = end - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    place = (at - np.repeat(first, length) + 1).astype(np.uint64)
    mixed = (points[at].astype(np.uint64) + np.uint64(0x51ED27)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    total = np.add.reduceat(mixed, starts)
    return (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
