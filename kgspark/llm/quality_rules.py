"""Quality rules: an isolation forest on rule statistics.

Each document gives counts (words, symbols, repeated lines and windows, ...) and ratios of them. Trees split their
range at random, and all good labelled documents are counted in the leaves; documents that few splits set apart from
them are anomalous. The score at which a document is rejected is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import PACKED, keep_rows, packed_counts, read_table, stage, summed_counts

WINDOW = 8
MIN_WORDS = 20
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
SPACES = tuple(bytes([c]) for c in b" \t\n\x0b\x0c\r")
UPPER, LOUD = bytes(range(65, 91)), b"!?"
FEATURES = ("symbols", "upper", "loud", "dup_lines", "repeats")
CELLS = 1 << 16  # of scores, when the limit is set
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    w = h[:n] * _MIX[0]
    for k in range(1, WINDOW):
        w = w + h[k : n + k] * _MIX[k]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w)
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    edges[at] += 1
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], features) of a UTF-8 text.

    Ratios lean on a few neutral counts, so that short texts aren't odd by chance alone.
    """
    words = raw.split()
    n = len(words)
    chars = len(raw.decode("utf-8", "replace")) - sum(map(raw.count, SPACES))
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    less = lambda cut: len(raw) - len(raw.translate(None, cut))
    shares = [
        symbols / (chars + 50),
        less(UPPER) / (chars + 50),
        less(LOUD) / (chars + 50),
        dup / (len(lines) + 5),
        repeat / (n + 20),
    ]
    features = [x**0.5 for x in shares]  # small shares matter more than large ones
    return [n, chars, symbols, dup, repeat], features


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def rule_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Statistics and features of each document. ``keep``: columns to carry. A null text has no words."""
    keep = keep or []
    kept = ", ".join(f"`{n}` {k}" for n, k in docs.select(*keep).dtypes) if keep else ""
    schema = (f"{kept}, " if kept else "") + STATS + ", features array<double>"
    names = [x.strip().split()[0] for x in STATS.split(",")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics((x.as_py() or b"")) for x in b.column(1)]
            counts = np.array([x[0] for x in found], dtype=np.int64).reshape(len(found), 5)
            features = pa.array([x[1] for x in found], pa.list_(pa.float64()))
            columns = [*(b.column(i) for i in range(2, b.num_columns)), b.column(0), *(pa.array(counts[:, i]) for i in range(5)), features]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names, "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), *keep)
    return rows.mapInArrow(scan, schema)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``anomaly`` in place of ``features``."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    rest = [c for c in stats.columns if c != "features"]
    kinds = dict(stats.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.score(matrix(b.columns[-1])))], [*rest, "anomaly"])

    return stats.select(*rest, "features").mapInArrow(scan, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", anomaly double")


def matrix(features: pa.Array) -> np.ndarray:
    return np.asarray(features.flatten(), dtype=np.float64).reshape(len(features), len(FEATURES))


@dataclass
class Forest:
    """Trees of one depth in arrays: node k has children 2k+1 and 2k+2; a leaf's path length is its depth and c(rows)."""

    feature: np.ndarray  # (trees, inner nodes)
    split: np.ndarray
    length: np.ndarray  # (trees, leaves)
    sample: int
    limit: float = 1.0

    @staticmethod
    def c(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of a failed search in a binary tree of n rows."""
        n = np.asarray(n, dtype=np.float64)
        m = np.maximum(n, 2)
        return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0) * np.where(n == 2, 1 / max(1e-9, 0.15443133), 1)

    @classmethod
    def grow(cls, box: np.ndarray, rows: int, trees: int = 200, sample: int = 256, seed: int = 5) -> Forest:
        """Trees of splits that are uniform in a node's part of ``box`` (least and most of each feature), lengths still 0.

        No row takes part in a split, so all rows can be counted in the leaves afterwards, and a region that none of
        them reaches is cut off by few splits, even where a feature never varies. Depths are those of ``sample`` rows.
        """
        rng = np.random.default_rng(seed)
        sample = min(sample, rows)
        depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        inner, leaves = 2**depth - 1, 2**depth
        feature, split = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf)
        for t in range(trees):
            parts = {0: box}
            for node in range(inner):
                part = parts.pop(node)
                wide = np.flatnonzero(part[1] > part[0])
                lower, upper = part.copy(), part.copy()
                if len(wide):  # without a split everything goes left
                    j = int(rng.choice(wide))
                    feature[t, node], split[t, node] = j, rng.uniform(part[0, j], part[1, j])
                    lower[1, j] = upper[0, j] = split[t, node]
                parts[2 * node + 1], parts[2 * node + 2] = lower, upper
        return cls(feature, split, np.zeros((trees, leaves)), sample)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        inner, index = self.feature.shape[1], np.arange(len(rows))
        for feature, split in zip(self.feature, self.split):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (rows[index, feature[node]] >= split[node])
            yield node - inner

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """(trees, leaves): how many rows each leaf has."""
        return np.stack([np.bincount(x, minlength=self.length.shape[1]) for x in self.leaves(rows)])

    def lengthen(self, counts: np.ndarray, rows: int) -> Forest:
        """Set path lengths by the rows of all leaves: a path ends where at most one row in ``sample`` is left, or nothing can be split."""
        mass = counts * (self.sample / rows)
        depth = int(np.log2(counts.shape[1]))
        self.length = depth + self.mean_path(mass)
        for level in range(depth - 1, -1, -1):  # the highest end counts
            first, width = 2**level - 1, counts.shape[1] >> level
            at = mass.reshape(len(mass), -1, width).sum(2)
            ended = (at <= 1 + 1e-9) | np.isinf(self.split[:, first : 2 * first + 1])
            self.length = np.where(np.repeat(ended, width, axis=1), np.repeat(level + self.mean_path(at), width, axis=1), self.length)
        return self

    @classmethod
    def mean_path(cls, mass: np.ndarray) -> np.ndarray:
        """``c`` of numbers that needn't be whole: straight lines between 1, 2 and 3."""
        return np.where(mass < 3, np.interp(mass, [1, 2, 3], cls.c(np.array([1, 2, 3]))), cls.c(np.maximum(mass, 3)))

    @classmethod
    def fit(cls, rows: np.ndarray, box: np.ndarray | None = None, trees: int = 200, sample: int = 256, seed: int = 5) -> Forest:
        forest = cls.grow(np.array([rows.min(0), rows.max(0)]) if box is None else box, len(rows), trees, sample, seed)
        return forest.lengthen(forest.counts(rows), len(rows))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ^ (- mean path length / c(sample)): near 1 for anomalies, 0.5 and less for ordinary rows."""
        total = np.zeros(len(rows))
        for length, leaf in zip(self.length, self.leaves(rows)):
            total += length[leaf]
        return 2.0 ** (-total / len(self.feature) / max(float(self.c(self.sample)), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = 0.995) -> float:
    """The highest balanced accuracy's limit among those that keep ``keep`` of the good rows; 1 (all kept) without both labels."""
    values, at = np.unique(scores, return_inverse=True)
    return limit_of(values, values, np.bincount(at, weights=good), np.bincount(at, weights=~good), keep)


def limit_of(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = 0.995) -> float:
    """``calibrate`` from counts of good and bad rows in cells of scores, in order, between ``low`` and ``high``."""
    if not good.sum() or not bad.sum():
        return 1.0
    cuts = np.append((high[:-1] + low[1:]) / 2, high[-1] + 1e-9) if len(low) > 1 else np.array([1.0])
    tpr, fpr = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    value = np.where(tpr >= keep, tpr - fpr, -1)
    best = np.flatnonzero(value == value.max())
    return float(cuts[best].mean()) if value.max() > 0 else 1.0


def text_statistics(docs: DataFrame) -> DataFrame:
    """Statistics, features and the text's hash of all documents, worked out once."""
    return stage(rule_statistics(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), ["h"]), "rule-statistics")


def fit_forest(docs: DataFrame, labels: DataFrame, seed: int = 5, stats: DataFrame | None = None) -> Forest | None:
    """A forest on all labelled documents: none is left out, and their rows stay in tasks.

    Trees split the range of all labelled rows that pass the base rules; every good one of them is counted in its leaf
    of every tree, and the limit is set on counts of all of them, in 65,536 cells of scores. The driver gets the range,
    the leaves' counts and the cells' counts. An id that several documents have stands for the one whose text has the
    smallest hash. None only where no good row passes the base rules; of very few rows the trees are shallow and reject
    little. ``stats``: ``text_statistics`` of ``docs``, where they are there already.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    rows = (text_statistics(docs) if stats is None else stats).join(ids, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "n_words", "n_repeat_words", "y", "features")).alias("s")).select("s.*")
    rows = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select((F.col("y") == 1).cast("int").alias("good"), "features")
    rows = stage(rows, "rule-labelled")
    ends = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n, *ends = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), *ends).first()
    if not n:
        return None
    forest = Forest.grow(np.array(ends, dtype=np.float64).reshape(2, -1), n, seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest_cells, np.int64)
        for b in batches:
            total += shared.value.counts(matrix(b.column(0))).ravel()
        yield from packed_counts({0: total})

    forest_cells = forest.length.size
    counts = summed_counts(rows.where("good = 1").select("features").mapInArrow(count, PACKED), 1, forest_cells)
    forest = forest.lengthen(counts.reshape(forest.length.shape), n)
    cell = F.floor(F.col("anomaly") * CELLS).cast("int").alias("cell")
    got = scored(rows, forest).groupBy(cell).agg(F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("cell").toArrow()
    cells, good = (got[x].to_numpy().astype(np.float64) for x in ("cell", "good"))
    forest.limit = limit_of(cells / CELLS, (cells + 1) / CELLS, good, got["n"].to_numpy() - good)
    return forest


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 30 * n_words)


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, anomaly for each document.

    A null text has no words and fails the base rule. Repeated rows are scored each. Extra columns don't matter. Without
    a good labelled row that passes the base rules the forest is absent and only the base rules reject.
    """
    stats = text_statistics(docs)
    forest = fit_forest(docs, labels, stats=stats)
    out = scored(stats.drop("h"), forest) if forest else stats.drop("h")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    passed = (F.col("anomaly") <= F.lit(forest.limit)) if forest else F.lit(True)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
    return out if forest else out.drop("features").withColumn("anomaly", F.lit(None).cast("double"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules and the forest keep.

    Null, empty and short texts go, as they fail the base rules; texts of any length are read whole. Repeated rows and
    ids are judged each by their text, null ids too. Columns of any name travel along. An empty table gives no rows.
    """
    forest = fit_forest(docs, read_table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(forest)

    def decide(texts: list[bytes]) -> np.ndarray:
        found = [statistics(t) for t in texts]
        counts = np.array([x[0] for x in found], dtype=np.int64).reshape(len(found), 5)
        kept = ~base_failed(counts[:, 0], counts[:, 4])
        if shared.value:
            kept &= shared.value.score(np.array([x[1] for x in found], dtype=np.float64).reshape(len(found), len(FEATURES))) <= shared.value.limit
        return kept

    return keep_rows(docs, decide, 1 << 24)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
