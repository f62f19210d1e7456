"""Periodic runs of words: longest common extensions by a difference cover, asked on a harmonic grid.

A run of period q and at least four periods holds two words q apart at a multiple of 3q, so for each q only every 3q-th
word is tried: about n / 3 x log(n) pairs a text. A pair's run reaches as far as the two places agree forwards and
backwards. A few words settle most pairs. For the rest, suffixes at places of a difference cover mod ``V`` are sorted
(by ``V`` words, then by doubling, which stays within the sample), neighbours' common lengths go to a sparse table of
minima, and any two places reach sampled ones in step within ``V`` words. Backwards is the same on the reversed words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import read_table, text_blocks

V = 32
LEAST, FOLDS = 6, 4  # words of a run at least, and periods
CHUNK = 1 << 20  # pairs tried at a time
BLOCK = 1 << 22


def cover(v: int) -> np.ndarray:
    """A small set of residues whose differences are all residues mod v, grown by what adds the most."""
    chosen, seen = [0], {0}
    while len(seen) < v:
        apart = lambda x: {(x - c) % v for c in chosen} | {(c - x) % v for c in chosen}  # noqa: B023, E731
        best = max((x for x in range(v) if x not in chosen), key=lambda x: (len(apart(x) - seen), -x))
        seen |= apart(best)
        chosen.append(best)
    return np.array(sorted(chosen))


COVER = cover(V)


def in_step() -> np.ndarray:
    """(V, V): how far two places, by residue, are from the next two that are both in the cover."""
    member = np.zeros(V, bool)
    member[COVER] = True
    i, j, d = np.ogrid[:V, :V, :V]
    return (member[(i + d) % V] & member[(j + d) % V]).argmax(2)


STEP = in_step()


def agree(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, way: int = 1) -> np.ndarray:
    """How many words from i and j on are the same, going ``way``, at most ``most``; x ends in words that are alone at both ends."""
    out, most = np.zeros(len(i), np.int64), np.broadcast_to(most, len(i))
    at = np.flatnonzero(most > 0)
    for k in range(int(most.max(initial=0))):
        at = at[x[i[at] + way * k] == x[j[at] + way * k]]
        out[at] = k + 1
        at = at[most[at] > k + 1]
        if not len(at):
            break
    return out


class Extensions:
    """Longest common extensions of places of ``x``, whose parts end in words that nothing else equals.

    Memory is some 40 bytes a word: the sample is a quarter of the places.
    """

    def __init__(self, x: np.ndarray, longest: int):
        self.x = x
        places = np.flatnonzero(np.isin(np.arange(V), COVER)[np.arange(len(x)) % V])
        self.index = np.full(len(x) + 1, -1, np.int32)
        self.index[places] = np.arange(len(places))
        word = np.append(np.unique(x, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), np.zeros(V + 1, np.uint64))
        order, names = np.arange(len(places)), []
        for k in range(V - 2, -1, -2):  # sort by V words, two at a time from the last on
            key = word[places + k] << np.uint64(32) | word[places + k + 1]
            order = order[np.argsort(key[order], kind="stable")]
        same = np.ones(len(places) - 1, bool)
        for k in range(0, V, 2):
            key = (word[places + k] << np.uint64(32) | word[places + k + 1])[order]
            same &= key[1:] == key[:-1]
        rank = np.empty(len(places), np.int64)
        rank[order] = np.cumsum(np.append(0, ~same))
        names.append(rank)
        reach = V
        while reach < longest and rank.max() < len(places) - 1:
            ahead = self.index[np.minimum(places + reach, len(x))]
            key = rank * (len(places) + 1) + np.where(ahead >= 0, rank[ahead] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(places), np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            names.append(rank)
            reach *= 2
        self.place_in_order = np.empty(len(places), np.int64)
        self.place_in_order[order] = np.arange(len(places))
        # neighbours' common lengths: whole doublings from the largest down, then single words
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(names) - 1, -1, -1):
            ia, ib = self.index[np.minimum(a + common, len(x))], self.index[np.minimum(b + common, len(x))]
            equal = (ia >= 0) & (ib >= 0)
            equal[equal] = names[k][ia[equal]] == names[k][ib[equal]]
            common += equal * (V << k)
        rest = np.flatnonzero(np.maximum(a, b) + common < len(x))
        common[rest] += agree(x, a[rest] + common[rest], b[rest] + common[rest], V)
        self.least = [common]
        while (width := 1 << len(self.least)) <= len(common):
            below = self.least[-1]
            self.least.append(np.minimum(below[: len(common) - width + 1], below[width // 2 : width // 2 + len(common) - width + 1]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same."""
        step = STEP[i % V, j % V]
        out = agree(self.x, i, j, step)
        on = np.flatnonzero(out == step)  # a part's end is alone, so places agree on less than what is left of x
        a, b = self.place_in_order[self.index[i[on] + step[on]]], self.place_in_order[self.index[j[on] + step[on]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(hi - lo)[1] - 1  # of the largest power of two within
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            out[on[some]] += np.minimum(self.least[k][lo[some]], self.least[k][hi[some] - (1 << k)])
        return out


def grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, i, q) of the pairs (i, i + q) to try in texts of n words, about ``CHUNK`` at a time."""
    text = np.repeat(np.arange(len(n)), n // FOLDS)
    q = np.arange(len(text)) - np.repeat(np.cumsum(n // FOLDS) - n // FOLDS, n // FOLDS) + 1
    many = (n[text] - q - 1) // ((FOLDS - 1) * q) + 1
    upto = np.cumsum(many)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
        m = many[lo:hi]
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(text[lo:hi], m), k * np.repeat((FOLDS - 1) * q[lo:hi], m), np.repeat(q[lo:hi], m)
        lo = hi


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of each text of word numbers from 0 on, by start, then period."""
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n + 1) - n  # a word that is alone stands ahead of each text and behind the last
    x = np.empty(int(n.sum()) + len(texts) + 1, np.int64)
    inside = np.ones(len(x), bool)
    inside[np.append(first - 1, len(x) - 1)] = False
    x[inside] = np.concatenate(texts) if texts else []
    x[~inside] = -1 - np.arange(len(texts) + 1)
    found, later = [], []
    for text, i, q in grid(n):
        at = first[text] + i
        hit = np.flatnonzero(x[at] == x[at + q])
        text, at, q = text[hit], at[hit], q[hit]
        ahead, back = agree(x, at, at + q, V), agree(x, at - 1, at + q - 1, V, -1)
        done = (ahead < V) & (back < V)
        long = done & (q + ahead + back >= np.maximum(LEAST, FOLDS * q))
        found.append(np.stack([text, at - back, q + ahead + back, q])[:, long])
        later.append(np.stack([text, at, q])[:, ~done])
    text, at, q = np.concatenate(later, axis=1) if later else np.zeros((3, 0), np.int64)
    if len(text):  # only texts with pairs that a few words don't settle
        some = np.unique(text)
        parts = [x[first[t] - 1 : first[t] + n[t]] for t in some]
        y = np.concatenate([*parts, [-2 - len(texts)]])
        lengths = n[some] + 1
        shift = (np.cumsum(lengths) - lengths + 1)[np.searchsorted(some, text)] - first[text]
        i, longest = at + shift, int(n[some].max())
        ahead = Extensions(y, longest)(i, i + q)
        back = Extensions(np.ascontiguousarray(y[::-1]), longest)(len(y) - i, len(y) - i - q)
        long = q + ahead + back >= np.maximum(LEAST, FOLDS * q)
        found.append(np.stack([text, at - back, q + ahead + back, q])[:, long])
    text, start, length, q = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    start -= first[text]
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    # a run of a smaller period is also found by its multiples; the smallest comes first
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([text, start, length, q], axis=1)[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:])]


class Numbers(dict):
    """A number for each word, in the order of their first places."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeating_tail(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place once the tail repeats; None where it doesn't."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def row_of(words: list[bytes], runs: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of one text."""
    if not len(runs):
        return 0, None, None, None, None, sha(b""), sha(b" ".join(words))
    start, length, q = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist()).encode()
    return len(runs), start, length, q, 1000 * length // q, sha(listed), sha(b" ".join([words[k] for k in kept]))


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every text.

    A run is a stretch of at least max(6, 4 x period) words, period its smallest, that no neighbouring word extends. The
    named run has the most periods (ties: the first, then the smallest period); the digests are of all runs, and of the
    words that are left when each run keeps its first period. Null, empty and wordless texts have no run: nulls, and
    digests of no bytes. With ``repeat_tails`` a tenth of the texts, by the id's crc32, first repeat a part of
    themselves to their end; a null id never does. Texts of any length count whole; rows are judged one by one, so
    repeats and repeated ids don't matter. An empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch, "text", BLOCK):
                numbers, words, texts = Numbers(), [], []
                for text, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    own = (text or b"").split()
                    tail = repeating_tail(len(own), zlib.crc32(key)) if repeat_tails and key is not None else None
                    words.append(own if tail is None else [own[k] for k in tail.tolist()])
                    texts.append(np.fromiter(map(numbers.__getitem__, words[-1]), np.int64, len(own)))
                rows = [row_of(w, r) for w, r in zip(words, find_runs(texts))]
                columns = [pa.array(c, pa.string() if "sha" in name else pa.int64()) for name, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("string").cast("binary").alias("key"))
    return rows.mapInArrow(scan, f"doc_id {kind}, {FIELDS}")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), repeat_tails=True)
