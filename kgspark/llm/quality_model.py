"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a text has a learned vector, found by its hash, and so have runs of three
words that the text had before. Their mean is the text's
vector, and a softmax layer turns it into class chances. Vectors and layer are trained by stochastic gradient descent
in numpy. To score, the vectors are multiplied by the layer once, so that a text costs one lookup a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.charvec import Chars, ngram_hashes, run_hashes, word_runs
from kgspark.llm.common import collect_sample, id_fold, labelled_sample, read_table, text_blocks

BITS = 16
ORDERS = (2, 4)


def features(chars: Chars) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first places of texts' features, buckets, which count) of each kind of feature, in the order of the text.

    Kinds: words, runs of three words (those already met in the text are told apart), character n-grams within words.
    Kinds share the 2 ^ BITS buckets, each with its own shift of the hash.
    """
    points = chars.points
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    first, end = word_runs(inside)
    words = run_hashes(points, first, end)
    bounds = np.searchsorted(first, chars.start[:-1])
    yield bounds, (words >> np.uint64(64 - BITS)).astype(np.int32), None
    owner = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(first))))
    three = words.copy()
    three[1:] += words[:-1] * np.uint64(0x9E3779B97F4A7C15)
    three[2:] += words[:-2] * np.uint64(0xBF58476D1CE4E5B9)
    three += owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(three, kind="stable")
    again = np.zeros(len(three), dtype=bool)
    again[order[1:]] = three[order[1:]] == three[order[:-1]]
    again &= np.arange(len(first)) - bounds[owner] >= 2  # a text's first two words end no run of three
    yield bounds, again.astype(np.int32), None  # bucket 1: three words met before, bucket 0: new ones
    whole, n_before = inside, 1  # where the last n places lie in one word
    for n in ORDERS:
        for k in range(n_before, n):
            whole = whole.copy()
            whole[k:] &= inside[:-k]
            whole[:k] = False
        n_before = n
        yield chars.start[:-1], ngram_hashes(points, n, BITS) ^ np.int32(n * 0x1A35 & (1 << BITS) - 1), whole


def text_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values from each bound to the next."""
    ends = np.append(bounds[1:], len(values))
    padded = np.append(values, values.dtype.type(0))
    return np.where(ends > bounds, np.add.reduceat(padded, np.minimum(bounds, len(values)), dtype=np.float64), 0.0)


@dataclass
class Model:
    vectors: np.ndarray  # (2 ^ BITS, dim)
    layer: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)

    def line(self) -> np.ndarray:
        """What a feature adds to the difference of the two classes' scores."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)

    def score(self, texts: list[str], line: np.ndarray) -> np.ndarray:
        """Chance of class 1 of each text; the bias alone decides on texts without features."""
        chars = Chars.of(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bounds, bucket, counts in features(chars):
            value = line[bucket] if counts is None else line[bucket] * counts
            total += text_sums(value, bounds)
            count += np.diff(np.append(bounds, len(bucket))) if counts is None else text_sums(counts.astype(np.float32), bounds)
        margin = total / np.maximum(count, 1) + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def train(texts: list[str], y: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 1.0, seed: int = 3) -> Model:
    """Stochastic gradient descent, one text a step; the rate falls to zero over the epochs."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1, 1, (1 << BITS, dim)) / dim, np.zeros((dim, 2)), np.log(np.array([np.mean(y == 0), np.mean(y == 1)]) + 1e-3))
    rows = []
    for text in texts:
        ids = np.concatenate([b if counts is None else b[counts] for _, b, counts in features(Chars.of([text]))])
        ids, n = np.unique(ids, return_counts=True)
        rows.append((ids, n / max(1, n.sum())))
    step, steps = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ model.vectors[ids]
            z = mean @ model.layer + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = model.layer @ p
            model.layer -= lr * np.outer(mean, p)
            model.bias -= 0.1 * lr * p
            model.vectors[ids] -= lr * share[:, None] * back * 10  # a mean over many features moves each a little
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = 2500, max_chars: int = 30_000, held_out: int = 5) -> Model | None:
    """A model from at most ``rows`` labelled documents of up to ``max_chars`` characters, none on fold 0 of ``held_out``."""
    texts, y = collect_sample(labelled_sample(docs, labels, "quality", rows, max_chars, held_out))
    return train(texts, (y == 1).astype(np.int64)) if len(y) else None


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_bytes: int = 1 << 20, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    A null text is empty; the bias scores it. Without labels every score is 0.5. A null id is not held out. Repeated
    rows are scored each; other columns are ignored.
    """
    model = model or fit_documents(docs, labels)
    # tasks get a number a bucket, not the vectors
    small = (Model(np.zeros((0, 0)), np.zeros((0, 0)), model.bias), model.line()) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch, "text", max_bytes):
                texts = [x.as_py() or "" for x in b.column(2)]
                score = shared.value[0].score(texts, shared.value[1]) if shared.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_fold(5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
