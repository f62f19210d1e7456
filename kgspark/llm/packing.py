"""Best-fit packing: best-two-fit over the histogram of piece lengths.

Pieces of one length are interchangeable, so bins are planned on counts by length (at most ``capacity`` of them):
fill a bin greedily with the longest pieces that fit, then replace its smallest piece with the two unpacked pieces
that fill the widened gap most, if they fill it better. A bin's pattern is repeated while the counts allow, so the
plan is as small as the histogram whatever the number of documents. Pieces are then numbered within their length
and look up their place in the plan.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import hash_salt, read_table, salts_for, stage, text_blocks

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
#: The fast encoder's pattern keeps a state for each character of a run of white space and overflows between 300,000 and
#: 1,000,000 of them; texts with runs above this length go to the exact one, which takes any.
SAFE_BLANKS = 1 << 16
_BLANKS = re.compile(r"\s{256,}")
_ENCODERS: dict = {}


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers as tokens

    return tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str]):
    """text -> ids of the tokenizer in ``files[0]``; the same ranks in ``files[1]`` give the same ids several times faster.

    Texts that hold the special token's own string go to the first, which has a single id for it, and so do texts with
    a run of more than ``SAFE_BLANKS`` white space characters, which the second can't hold.
    """
    if files not in _ENCODERS:
        import public_tokenizers as tokens
        import tiktoken
        from tokenizers import Tokenizer

        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        exact: list = []

        def encode(text: str) -> list[int]:
            if SPECIAL in text or longest_blank(text) > SAFE_BLANKS:
                if not exact:
                    exact.append(Tokenizer.from_file(files[0]))
                return exact[0].encode(text, add_special_tokens=False).ids
            return fast(text)

        _ENCODERS[files] = encode
    return _ENCODERS[files]


def longest_blank(text: str) -> int:
    """Length of the longest run of white space, of those that could matter (0 for texts too short to have one)."""
    if len(text) <= SAFE_BLANKS:
        return 0
    return max((m.end() - m.start() for m in _BLANKS.finditer(text)), default=0)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole capacities behind a first piece that may be shorter."""
    first = n if n <= capacity else (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def document_pieces(docs: DataFrame, files: tuple[str, str], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token pieces of each document, its end id included. A null text is empty."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        for batch in batches:
            for part in text_blocks(batch, "text", 1 << 24):
                ids, out = part.column(0).to_pylist(), ([], [], [], [], [])
                for doc_id, text in zip(ids, part.column(1)):
                    tokens = encode(text.as_py() or "")
                    tokens.append(END_ID)
                    raw = np.array(tokens, dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(raw[start : start + length].tobytes()))):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit: (lengths in a bin, longest first; how many such bins) until all counts are used."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        bin_, gap, top = [], capacity, len(there)
        while gap and (top := int(np.searchsorted(there[:top], gap, side="right"))):
            length = int(there[top - 1])
            take = min(int(left[length]) - bin_.count(length), gap // length)
            if take <= 0:
                top -= 1
                continue
            bin_ += [length] * take
            gap -= length * take
            top -= 1
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            wide = gap + smallest
            rest = left.copy()
            for length in bin_[:-1]:
                rest[length] -= 1
            rest[smallest] -= 1  # it is the one replaced
            free = np.flatnonzero(rest[: wide + 1])
            if len(free):
                at = np.searchsorted(free, wide - free, side="right") - 1  # the longest partner of each
                partner = np.where(at >= 0, free[np.maximum(at, 0)], -1)
                same = (partner == free) & (rest[free] < 2)
                lower = np.where(at >= 1, free[np.maximum(at - 1, 0)], -1)
                partner = np.where(same, lower, partner)
                total = np.where(partner > 0, free + partner, -1)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    bin_[-1:] = sorted((int(free[best]), int(partner[best])), reverse=True)
        used = np.bincount(bin_, minlength=capacity + 1)
        lengths = np.flatnonzero(used)
        times = int((left[lengths] // used[lengths]).min())
        left -= used * times
        out.append((bin_, times))


def slot_table(plan: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: a run of ``times`` pieces fills one position of a pattern's bins in order."""
    run = {k: [] for k in ("length", "rank", "bin", "offset")}
    next_rank, first_bin = np.zeros(capacity + 1, dtype=np.int64), 0
    for bin_, times in plan:
        offset = 0
        for length in bin_:
            for k, v in zip(run, (length, next_rank[length], first_bin, offset)):
                run[k].append(int(v))
            next_rank[length] += times
            offset += length
        first_bin += times
    table = {k: np.array(v, dtype=np.int64) for k, v in run.items()}
    order = np.lexsort((table["rank"], table["length"]))
    return {k: v[order] for k, v in table.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, piece, length, ...), each length 1 to ``capacity``.

    The driver holds a count a length; the plan that tasks get is bounded by ``capacity`` too. Ranks within a length
    come from even cells (length, salt), so a length that a third of all pieces have is spread.
    """
    # numbers of written rows spread whatever ids and texts are alike
    base = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slot_table(plan_bins(counts, capacity), capacity)
    cells = base.withColumn("_salt", hash_salt(salts_for(max(counts.values(), default=0), 16, 512), "_row"))
    sums = cells.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sums = sums.select("length", "_salt", F.expr("sum(_n) over (partition by length order by _salt) - _n").alias("_before"))
    ranked = cells.withColumn("_in", F.expr("row_number() over (partition by length, _salt order by _row)"))
    # at most capacity x salts rows on the broadcast side
    ranked = ranked.join(F.broadcast(sums), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        base_, step = t["length"], 1 << 44
        keys = base_ * step + t["rank"]
        for b in batches:
            length = np.asarray(b.column(b.schema.get_field_index("length")), dtype=np.int64)
            rank = np.asarray(b.column(b.schema.get_field_index("_rank")), dtype=np.int64)
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array(t["bin"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{n} {k}" for n, k in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the single end id. Texts of any length and any run of blanks are cut, never truncated. Repeated rows are packed
    each. Other columns are ignored. An empty table gives no rows.
    """
    pieces = document_pieces(docs, files or tokenizer_files(), capacity)
    out = pack_pieces(pieces, capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces and their places. Every row is packed, as of ``pack_documents``."""
    return pack_documents(docs)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
