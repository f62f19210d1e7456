"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its own vector (by hash) beside the mean vector of its character n-grams. Windows of words overlap;
each is read in both directions, attention weighs its places, and the pooled state gives the chance that it is toxic.
A text scores as its worst window. Trained in numpy on labelled texts, each through its worst windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.charvec import Chars, ngram_hashes, run_hashes, script_table, word_runs
from kgspark.llm.common import collect_sample, id_fold, labelled_sample, read_table, text_blocks
from kgspark.llm.langid import lower_same_length

WORD_BITS, CHAR_BITS = 14, 15
WORD_DIM, CHAR_DIM = 6, 6
ORDERS = (3, 4, 5)
HIDDEN, ATTEND = 8, 8
WINDOW, STRIDE = 24, 16  # a phrase of up to 9 words lies whole in some window


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.asarray(0.5, x.dtype)


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places first ... first + length - 1 of every run, end to end."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


@dataclass
class Words:
    """A block of texts as word numbers: ``of`` indexes distinct words; each has a bucket and character n-gram buckets."""

    start: np.ndarray  # first word of each text, and the end
    of: np.ndarray
    bucket: np.ndarray
    gram_start: np.ndarray
    gram_count: np.ndarray
    gram: np.ndarray

    @classmethod
    def read(cls, texts: list[str]) -> Words:
        chars = Chars.of([lower_same_length(t) for t in texts])
        p = chars.points
        first, end = word_runs((script_table()[p] > 0) | ((p >= 48) & (p <= 57)))
        start = np.append(np.searchsorted(first, chars.start[:-1]), len(first))
        hashes, at, of = np.unique(run_hashes(p, first, end), return_index=True, return_inverse=True)
        first, length = first[at], (end - first)[at]
        # distinct words with a blank on either side
        wide = length + 2
        base = np.cumsum(wide) - wide
        spelled = np.full(int(wide.sum()), 32, dtype=np.uint32)
        spelled[ragged(base + 1, length)] = p[ragged(first, length)]
        place = np.arange(len(spelled)) - np.repeat(base, wide)
        owner = np.repeat(np.arange(len(length)), wide)
        grams, owners = [], []
        for n in ORDERS:
            fits = place >= n - 1
            grams.append(((ngram_hashes(spelled, n, CHAR_BITS) ^ np.int32(n * 0x2F1D & (1 << CHAR_BITS) - 1)))[fits])
            owners.append(owner[fits])
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        count = np.bincount(owners, minlength=len(length))
        return cls(start, of, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32), np.cumsum(count) - count, count, grams[order])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all overlapping windows; texts without words have none."""
        n = np.diff(self.start)
        many = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        text = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        inside = np.maximum(0, np.minimum(k * STRIDE, n[text] - WINDOW))
        return text, self.start[text] + inside, np.minimum(n[text], WINDOW)


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"word": normal(1 << WORD_BITS, WORD_DIM), "char": normal(1 << CHAR_BITS, CHAR_DIM)}
    for side in "fb":
        p |= {f"x{side}": normal(d, 3 * h), f"u{side}": normal(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    return p | {"wa": normal(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": normal(ATTEND, 1)[:, 0], "wo": normal(2 * h, 1)[:, 0], "bo": np.zeros(1, np.float32)}


def inputs(p: dict, words: Words, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of distinct words, their n-grams' buckets, n-gram counts)."""
    first, count = (words.gram_start, words.gram_count) if which is None else (words.gram_start[which], words.gram_count[which])
    gram = words.gram if which is None else words.gram[ragged(first, count)]
    bucket = words.bucket if which is None else words.bucket[which]
    if not len(bucket):
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), gram, count
    mean = np.add.reduceat(p["char"][gram], np.cumsum(count) - count, axis=0) / count[:, None].astype(np.float32)
    return np.concatenate([p["word"][bucket], mean], axis=1), gram, count


def read_side(p: dict, side: str, gates: np.ndarray, at: np.ndarray, real: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (windows, places, HIDDEN) of one direction. ``gates``: input part of the gates of each distinct word."""
    b, t_all, h = len(at), at.shape[1], HIDDEN
    out, state = np.empty((t_all, b, h), np.float32), np.zeros((b, h), np.float32)
    u = p[f"u{side}"]
    for t in range(t_all) if side == "f" else range(t_all - 1, -1, -1):
        x, hu = gates[at[:, t]], state @ u
        zr = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
        z, r, un = zr[:, :h], zr[:, h:], hu[:, 2 * h :]
        n = np.tanh(x[:, 2 * h :] + r * un)
        new = n + z * (state - n)
        if real is not None:
            new *= real[:, t : t + 1]  # behind the end of a short window the state stays zero
        if keep is not None:
            keep.append((t, state, z, r, un, n))
        out[t] = state = new
    return out


def forward(p: dict, gates: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    sides = [read_side(p, s, gates[s], at, real, None if keep is None else keep.setdefault(s, [])) for s in "fb"]
    states = np.concatenate(sides, axis=2)  # (places, windows, 2 HIDDEN)
    a = np.tanh(states @ p["wa"] + p["ba"])
    e = a @ p["va"]
    if real is not None:
        e = np.where(real.T > 0, e, np.float32(-1e9))
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, states)
    if keep is not None:
        keep |= {"states": states, "a": a, "w": w, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"][0]


def backward(p: dict, keep: dict, at: np.ndarray, real: np.ndarray, d_logit: np.ndarray, n_words: int) -> tuple[dict, dict[str, np.ndarray]]:
    """(gradients of the network, gradients of the gates' input parts of each distinct word)."""
    h, states, a, w = HIDDEN, keep["states"], keep["a"], keep["w"]
    g = {"wo": keep["pooled"].T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["wo"]
    d_w = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(0))
    d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
    g["va"] = np.einsum("tb,tba->a", d_e, a)
    g["ba"] = d_a.sum((0, 1))
    g["wa"] = np.einsum("tbh,tba->ha", states, d_a)
    d_states = w[:, :, None] * d_pooled + d_a @ p["wa"].T
    d_gates = {}
    for k, s in enumerate("fb"):
        u, g_u = p[f"u{s}"], np.zeros_like(p[f"u{s}"])
        d_x, d_h = np.zeros((n_words, 3 * h), np.float32), np.zeros((at.shape[0], h), np.float32)
        for t, state, z, r, un, n in reversed(keep[s]):
            d_new = (d_states[t, :, k * h : (k + 1) * h] + d_h) * real[:, t : t + 1]
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (state - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            np.add.at(d_x, at[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
            g_u += state.T @ d_hu
            d_h = d_new * z + d_hu @ u.T
        g[f"u{s}"], d_gates[s] = g_u, d_x
    return g, d_gates


def window_places(words: Words, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word at each place of each window, 1 where the place is in the window)."""
    k = np.arange(WINDOW)
    real = (k < n[:, None]).astype(np.float32)
    return words.of[first[:, None] + np.minimum(k, n[:, None] - 1)], real


def window_logits(p: dict, words: Words, first: np.ndarray, n: np.ndarray, block: int = 2048) -> np.ndarray:
    vectors, _, _ = inputs(p, words)
    gates = {s: vectors @ p[f"x{s}"] + p[f"c{s}"] for s in "fb"}
    out = np.empty(len(first), np.float32)
    order = np.argsort(n < WINDOW, kind="stable")  # full windows need no mask
    whole = int((n == WINDOW).sum())
    for lo, hi in [(i, min(i + block, whole)) for i in range(0, whole, block)] + [(i, min(i + block, len(n))) for i in range(whole, len(n), block)]:
        k = order[lo:hi]
        at, real = window_places(words, first[k], n[k])
        out[k] = forward(p, gates, at, None if lo < whole else real)
    return out


def surplus_start(p: dict, words: Words, y: np.ndarray) -> None:
    """First coordinate of each vector: how far more toxic texts have the word or n-gram than chance gives, in deviations."""
    n_texts = len(words.start) - 1
    text = np.repeat(np.arange(n_texts), np.diff(words.start))
    seen = np.unique(text.astype(np.int64) * len(words.bucket) + words.of)
    text, word = seen // max(1, len(words.bucket)), seen % max(1, len(words.bucket))

    def odds(owner: np.ndarray, bucket: np.ndarray, size: int) -> np.ndarray:
        pair = np.unique(owner.astype(np.int64) * size + bucket)
        bad = np.bincount(pair[y[pair // size] == 1] % size, minlength=size)
        good = np.bincount(pair[y[pair // size] == 0] % size, minlength=size)
        expected = (bad + good) * y.mean()
        surplus = np.clip((bad - expected) / np.sqrt(expected + 1) / 2, -1, 3)
        # what few texts have would only name those texts, and small surpluses are chance
        return np.where((bad + good >= 5) & (np.abs(surplus) > 0.75), surplus, 0)

    p["word"][:, 0] = odds(text, words.bucket[word], 1 << WORD_BITS)
    grams = words.gram[ragged(words.gram_start[word], words.gram_count[word])]
    p["char"][:, 0] = odds(np.repeat(text, words.gram_count[word]), grams, 1 << CHAR_BITS)


def train(texts: list[str], y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 9) -> dict[str, np.ndarray]:
    """Adam over the windows that now score worst in each text, and one more at random in texts that aren't toxic."""
    rng = np.random.default_rng(seed)
    words, p = Words.read(texts), new_parameters(rng)
    surplus_start(p, words, y)
    text, first, n = words.windows()
    if not len(text) or y.min() == y.max():
        p["bo"][:] = 4 if len(y) and y.min() == 1 else -4
        return p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    p["bo"][:] = np.log(y.mean() / (1 - y.mean()))
    heavy = np.where(y == 1, min(4.0, (1 - y.mean()) / y.mean()) ** 0.5, 1.0).astype(np.float32)
    bounds, step = np.searchsorted(text, np.arange(len(texts) + 1)), 0
    there = np.flatnonzero(np.diff(bounds))
    for epoch in range(epochs):
        logits = window_logits(p, words, first, n)
        order = np.lexsort((-logits, text))
        worst = order[bounds[:-1][there]]
        other = there[y[there] == 0]
        spare = bounds[other] + (rng.random(len(other)) * np.diff(bounds)[other]).astype(np.int64)
        chosen = np.concatenate([worst, spare])
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), batch):
            k = chosen[lo : lo + batch]
            at, real = window_places(words, first[k], n[k])
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(len(k), WINDOW)
            vectors, gram, count = inputs(p, words, used)
            keep: dict = {}
            logit = forward(p, {s: vectors @ p[f"x{s}"] + p[f"c{s}"] for s in "fb"}, at, real, keep)
            d_logit = ((sigmoid(logit) - y[text[k]]) * heavy[text[k]] / len(k)).astype(np.float32)
            g, d_gates = backward(p, keep, at, real, d_logit, len(used))
            d_vectors = np.zeros_like(vectors)
            for s in "fb":
                g[f"x{s}"], g[f"c{s}"] = vectors.T @ d_gates[s], d_gates[s].sum(0)
                d_vectors += d_gates[s] @ p[f"x{s}"].T
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], words.bucket[used], d_vectors[:, :WORD_DIM])
            np.add.at(g["char"], gram, np.repeat(d_vectors[:, WORD_DIM:] / count[:, None], count, axis=0))
            step += 1
            lr = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, grad in g.items():
                m, v = moment[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                slow = 0.1 if name in ("word", "char") else 1.0  # else vectors learn texts by heart
                p[name] -= (slow * lr * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return p


def score_texts(p: dict, texts: list[str]) -> np.ndarray:
    """Chance of toxicity of each text: its worst window's; 0 for texts without words."""
    words = Words.read(texts)
    text, first, n = words.windows()
    out = np.zeros(len(texts))
    np.maximum.at(out, text, sigmoid(window_logits(p, words, first, n).astype(np.float64)))
    return out


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = 2000, max_chars: int = 12_000, held_out: int = 5) -> dict | None:
    """A network from at most ``rows`` labelled documents of up to ``max_chars`` characters, none on fold 0 of ``held_out``."""
    texts, y = collect_sample(labelled_sample(docs, labels, "toxic", rows, max_chars, held_out))
    return train(texts, (y == 1).astype(np.int64)) if len(y) else None


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_bytes: int = 2 << 20, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document, all windows of its whole text read.

    Null, empty and wordless texts score 0, and so does everything without labels. A null id is not held out. Repeated
    rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_documents(docs, labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch, "text", max_bytes):
                texts = [x.as_py() or "" for x in b.column(2)]
                score = score_texts(shared.value, texts) if shared.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_fold(5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
