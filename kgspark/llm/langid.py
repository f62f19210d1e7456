"""Language identification: script ranges narrow candidates, then Viterbi labels spans of mixed-language text.

A word's score for a language is the sum of its character-trigram log-likelihoods. Only languages seen with the
word's script compete. Viterbi over the words of a text, with a penalty for switching, labels each word; runs of one
label are the text's spans, and the language that holds most letters is the text's. Long texts are cut into chunks that
advance together: the best path through each chunk for every pair of labels at its ends, then the best chain of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.charvec import SCRIPT_NAMES, Chars, ngram_hashes, script_table, word_runs
from kgspark.llm.common import PACKED, id_fold, keep_rows, one_text_an_id, packed_counts, read_table, summed_counts, text_blocks

BITS = 16
CELLS = 1 << 24  # trigram counts of all languages together: with over 256 languages each has fewer hash buckets
CHUNK = 1024
BLOCK = 1 << 20  # bytes of text whose arrays a task holds at once
ORDER = 3
UNKNOWN = "und"
OUT_OF_SCRIPT = -1e4


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (2 ^ BITS, languages) log-likelihoods, float32
    scripts: np.ndarray  # (scripts, languages): 0 or OUT_OF_SCRIPT
    penalty: float = 12.0


@dataclass
class Words:
    """Words (runs of letters) of a block of texts, their trigram places and scripts."""

    chars: Chars
    first: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: np.ndarray

    @classmethod
    def of(cls, texts: list[str], bits: int = BITS) -> Words:
        chars = Chars.of([lower_same_length(t) for t in texts])
        scripts = script_table()[chars.points]
        first, end = word_runs(scripts > 0)
        spaced = np.where(scripts > 0, chars.points, np.uint32(32))
        grams = ngram_hashes(np.append(spaced, np.uint32(32)), ORDER, bits)[1:]  # at a place: the letter before, it, the next
        return cls(chars, first, end, chars.text_of(first), scripts[first], grams)

    def places(self) -> np.ndarray:
        length = self.end - self.first
        return np.repeat(self.first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))


def lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def count_words(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams by bucket, letters by script) of texts."""
    words = Words.of(texts, bits)
    return (
        np.bincount(words.grams[words.places()], minlength=1 << bits),
        np.bincount(words.script, weights=words.end - words.first, minlength=len(SCRIPT_NAMES)).astype(np.int64),
    )


def from_counts(names: list[str], counts: np.ndarray, scripts: np.ndarray, smooth: float = 0.5) -> Model:
    """A model from (buckets, languages) and (scripts, languages) counts."""
    counts = counts + smooth
    log = np.log(counts / counts.sum(0))
    log -= log.max(1, keepdims=True)
    used = scripts >= 0.005 * np.maximum(scripts.sum(0), 1)
    used &= scripts > 0
    used |= ~used.any(1, keepdims=True)  # a script nobody was seen with narrows nothing
    return Model(names, log.astype(np.float32), np.where(used, 0, OUT_OF_SCRIPT).astype(np.float32))


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    found = [count_words([t for t, x in zip(texts, langs) if x == name]) for name in names]
    return from_counts(names, np.stack([x for x, _ in found], axis=1), np.stack([x for _, x in found], axis=1))


def longest_first(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences that have a word, the longest first; how many of them are longer than t, for each t)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    top = int(lengths[order[0]]) if len(order) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(top), side="left")


def best_paths(scores: np.ndarray, start: np.ndarray, lengths: np.ndarray, penalty: float, best: np.ndarray, ends: np.ndarray) -> None:
    """Write the best label of each word to ``best``: sequences of ``lengths`` words from ``start`` on, all advancing together.

    ``ends``: labels that the first and the last word of each sequence must have, -1 where they are free.
    """
    labels, (order, running) = scores.shape[1], longest_first(lengths)
    if not len(order):
        return
    start, lengths, ends, own = start[order], lengths[order], ends[order], np.arange(labels, dtype=best.dtype)
    at_most = np.cumsum(lengths) - lengths
    back = np.empty((int(lengths.sum()), labels), dtype=best.dtype)
    value = np.where((ends[:, :1] < 0) | (own == ends[:, :1]), scores[start].astype(np.float64), -np.inf)
    for t in range(1, int(lengths[0])):
        n = running[t]
        v = value[:n]
        top = v.argmax(1)
        jump = v[np.arange(n), top] - penalty
        switch = jump[:, None] > v
        back[at_most[:n] + t] = np.where(switch, top[:, None].astype(best.dtype), own)
        value[:n] = np.where(switch, jump[:, None], v) + scores[start[:n] + t]
        value[:n] -= value[:n].max(1, keepdims=True)
    state = np.where(ends[:, 1] < 0, value.argmax(1), ends[:, 1])
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = running[t]
        best[start[:n] + t] = state[:n]
        if t:
            state[:n] = back[at_most[:n] + t, state[:n]]


def chunk_values(scores: np.ndarray, start: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """(chunks, first label, last label): value of the best path through each chunk with these labels at its ends."""
    labels, (order, running) = scores.shape[1], longest_first(lengths)
    start = start[order]
    value = np.where(np.eye(labels, dtype=bool), scores[start].astype(np.float64)[:, None, :], -np.inf)
    for t in range(1, len(running)):
        n = running[t]
        v = value[:n]
        value[:n] = np.maximum(v, v.max(2, keepdims=True) - penalty) + scores[start[:n] + t][:, None, :]
    out = np.empty_like(value)
    out[order] = value
    return out


def chunk_ends(values: np.ndarray, penalty: float) -> np.ndarray:
    """(first, last) label of each chunk of one text on its best path."""
    value, back = values[0].max(0), [(values[0].argmax(0), None)]
    for m in values[1:]:
        top = int(value.argmax())
        enter = np.maximum(value, value[top] - penalty)
        came = np.where(value >= enter, np.arange(len(value)), top)
        total = enter[:, None] + m
        first = total.argmax(0)
        value = total[first, np.arange(len(first))]
        value -= value.max()
        back.append((first, came))
    last, out = int(value.argmax()), np.empty((len(values), 2), dtype=np.int64)
    for k in range(len(values) - 1, -1, -1):
        first, came = back[k]
        out[k] = first[last], last
        last = int(came[first[last]]) if k else last
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float, chunk: int = CHUNK) -> np.ndarray:
    """Best label of each word: ``scores`` (words, labels) of sequences of ``lengths`` laid end to end.

    Sequences of over ``chunk`` words are cut, and all chunks advance together too, so that one long text takes no more
    steps than many short ones. A label takes 1 byte, or 2 with over 256 languages.
    """
    labels, start = scores.shape[1], np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    best = np.zeros(len(scores), dtype=np.uint8 if labels <= 256 else np.uint16)
    short, long = lengths <= chunk, np.flatnonzero(lengths > chunk)
    many = -(-lengths[long] // chunk)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    part_start = np.repeat(start[long], many) + at * chunk
    part = np.minimum(chunk, np.repeat(lengths[long], many) - at * chunk)
    ends = np.empty((len(part), 2), dtype=np.int64)
    if len(part):
        at_once = max(1, (1 << 22) // (labels * labels))
        values = np.concatenate([chunk_values(scores, part_start[k : k + at_once], part[k : k + at_once], penalty) for k in range(0, len(part), at_once)])
        for first, n in zip(np.cumsum(many) - many, many):
            ends[first : first + n] = chunk_ends(values[first : first + n], penalty)
    free = np.full((int(short.sum()), 2), -1, dtype=np.int64)
    best_paths(scores, np.concatenate([start[short], part_start]), np.concatenate([lengths[short], part]), penalty, best, np.concatenate([free, ends]))
    return best


def label_words(model: Model, words: Words, n_texts: int) -> np.ndarray:
    """Language number of each word."""
    if not len(words.first):
        return np.zeros(0, np.uint8)
    at, length = words.places(), words.end - words.first
    bounds = np.concatenate([[0], np.cumsum(length)[:-1]])
    scores = np.add.reduceat(model.weight[words.grams[at]], bounds, axis=0) + model.scripts[words.script]
    return viterbi(scores, np.bincount(words.text, minlength=n_texts), model.penalty)


@dataclass
class Found:
    """Languages of a block of texts: the main one and its share of the letters, and the spans of each text."""

    lang: list[str]
    share: np.ndarray
    bounds: np.ndarray  # first span of each text, and the end
    first: np.ndarray  # spans: first place in the text, place behind the last, language number
    end: np.ndarray
    label: np.ndarray


def identify(model: Model, texts: list[str]) -> Found:
    words = Words.of(texts, int(model.weight.shape[0]).bit_length() - 1)
    label, n = label_words(model, words, len(texts)), len(model.langs)
    letters = np.bincount(words.text * n + label, weights=words.end - words.first, minlength=len(texts) * n).reshape(len(texts), n)
    total = letters.sum(1)
    share = np.where(total > 0, letters.max(1, initial=0) / np.maximum(total, 1), 0.0)
    lang = [model.langs[k] if t > 0 else UNKNOWN for k, t in zip(letters.argmax(1), total)]
    new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])])) if len(label) else np.zeros(0, int)
    last = np.append(new[1:], len(label)) - 1 if len(new) else new
    base = words.chars.start[words.text[new]]
    bounds = np.searchsorted(words.text[new], np.arange(len(texts) + 1))
    return Found(lang, share, bounds, words.first[new] - base, words.end[last] - base, label[new])


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(first place, place behind the last, language) of the runs of words that Viterbi gives one language."""
    found = identify(model, [text])
    return [(int(a), int(b), model.langs[k]) for a, b, k in zip(found.first, found.end, found.label)]


def fit_documents(docs: DataFrame, per_lang: int = 400, modulus: int = 4, held_out: int = 2) -> Model | None:
    """A model from up to ``per_lang`` documents (smallest seeded hashes of ids) of each language on other folds than ``held_out``.

    Ids and languages alone pick the sample; its whole texts, of any length, are then counted in tasks, and only counts
    by (language, trigram bucket), ``CELLS`` at most, reach the driver. An id that several documents have stands for the
    one whose text has the smallest hash. None if there is nothing to learn from.
    """
    rows = docs.where("doc_id is not null and lang is not null").where(id_fold(modulus) != held_out)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    names = sorted(counts)
    bits = max(8, min(BITS, (CELLS // len(names)).bit_length() - 1))
    # a seeded hash first thins each language to a few times what is wanted, so that the ranking below is small everywhere
    seeded = F.xxhash64(F.lit(3), "doc_id")
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 3.0 * per_lang / n))])[F.col("lang")]
    thin = rows.select("doc_id", "lang").where(F.pmod(seeded, F.lit(1 << 20)) < share * (1 << 20)).distinct()
    lot = Window.partitionBy("lang").orderBy(seeded, "doc_id")
    ids = thin.withColumn("_k", F.row_number().over(lot)).where(F.col("_k") <= per_lang)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    sample = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")
    number, width = {name: k for k, name in enumerate(names)}, (1 << bits) + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b in text_blocks(batch, "text", BLOCK):
                langs, texts = b.column(0).to_pylist(), [x.as_py() or "" for x in b.column(1)]
                for name in set(langs):
                    # buckets of trigrams, and behind them scripts
                    n = np.concatenate(count_words([t for t, x in zip(texts, langs) if x == name], bits))
                    k = number[name]
                    sums[k] = sums[k] + n if k in sums else n
                    if len(sums) * width > 1 << 21:  # many languages: no task holds them all
                        yield from packed_counts(sums)
                        sums = {}
        yield from packed_counts(sums)

    cells = one_text_an_id(sample, "doc_id", "lang").select("lang", "text").mapInArrow(count, PACKED)
    table = summed_counts(cells, len(names), width).T
    return from_counts(names, table[: 1 << bits], table[1 << bits :])


COLUMNS = "doc_id long, held_out boolean, lang_pred string, score double, n_spans int, spans array<struct<first: int, end: int, lang: string>>"


def identify_documents(docs: DataFrame, max_bytes: int = BLOCK, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans, spans for each document.

    ``score``: the language's share of the letters. ``spans``: the runs of words of one language, by first character and
    the one behind the last. Texts that are null or without a letter have no spans, and they, and all texts when nothing
    could be learned, are ``und`` with score 0. A null id is not held out. Repeated rows are labelled each; extra columns
    don't matter; long texts are read whole; an empty table gives no rows.
    """
    model = model or fit_documents(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")[:6]]
        for batch in batches:
            for b in text_blocks(batch, "_text", max_bytes):
                texts = [x.as_py() or "" for x in b.column(2)]
                none = np.zeros(0, np.int64)
                found = identify(shared.value, texts) if shared.value else Found([UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64), none, none, none)
                langs = pa.array(np.array(shared.value.langs, dtype=object)[found.label], pa.string()) if len(found.label) else pa.array([], pa.string())
                span = pa.StructArray.from_arrays([pa.array(found.first.astype(np.int32)), pa.array(found.end.astype(np.int32)), langs], ["first", "end", "lang"])
                lists = pa.ListArray.from_arrays(pa.array(found.bounds.astype(np.int32)), span)
                columns = [b.column(0), b.column(1), pa.array(found.lang, pa.string()), pa.array(found.share, pa.float64()), pa.array(np.diff(found.bounds).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(id_fold(4) == 2, F.lit(False)).alias("_out"), F.col("text").alias("_text"))
    return rows.mapInArrow(scan, COLUMNS)


def language_stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: documents in a known language that holds at least ``least`` of their letters.

    Null, empty and letterless texts go, and everything where no document names its language. Repeated rows and null ids
    are judged by their text; columns of any name travel along. An empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(fit_documents(docs))

    def decide(texts: list[bytes]) -> np.ndarray:
        if not shared.value:
            return np.zeros(len(texts), dtype=bool)
        found = identify(shared.value, [t.decode("utf-8", "replace") for t in texts])
        return (np.array(found.lang, dtype=object) != UNKNOWN) & (found.share >= least)

    return keep_rows(docs, decide, BLOCK)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_documents(read_table(spark, sf_dir, "documents"))
