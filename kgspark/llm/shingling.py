"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from kgspark.llm.charvec import run_hashes, word_runs

_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLACE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of each text, sorted; first one of each text, and the end).

    Words are runs of other than white space, A-Z lower-cased. A text of fewer words is one shingle; one of none has none.
    """
    points = np.frombuffer(b"\n".join([*texts, b""]).translate(_SMALL), dtype=np.uint8)
    first, end = word_runs(~((points == 32) | ((points >= 9) & (points <= 13))))
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    words = run_hashes(points, first, end)
    bounds = np.searchsorted(first, start)
    n = np.diff(bounds)
    h = np.zeros(len(words), np.uint64)
    for k in range(size):
        h[: len(h) - k] += words[k:] * _PLACE[k]
    for i in np.flatnonzero((n > 0) & (n < size)):
        h[bounds[i]] = (words[bounds[i] : bounds[i + 1]] * _PLACE[: n[i]]).sum(dtype=np.uint64)
    h = mixed(h)
    many, out = np.where(n >= size, n - size + 1, np.minimum(n, 1)), []
    for lo, m in zip(bounds[:-1].tolist(), many.tolist()):  # text by text: small sorts stay in the cache
        x = np.sort(h[lo : lo + m])
        out.append(x[np.append(True, x[1:] != x[:-1])] if m > 1 else x)
    return np.concatenate(out) if out else h, np.cumsum([0, *map(len, out)])


def majority(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SimHash of each set of hashes: the bits that over half of them have; 0 for empty sets."""
    out, n = np.zeros(len(start) - 1, np.uint64), np.diff(start)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, start[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(votes * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out
