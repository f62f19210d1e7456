"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of equal texts lie in the order of their 64-bit text hash. The smallest shard capacity that lets a greedy
walk fit all groups into the shards is found by binary search. The walk needs sizes of all groups, which no driver
may hold, so it works on cells (ranges of the hash order) and opens only cells that may hold a cut:

* treating each cell as one piece gives a capacity that surely works,
* letting cells be cut anywhere gives a capacity below which nothing works,
* each round splits the cells that keep the two apart, until they meet.

The driver holds cells, not groups. When cells are the pieces, the two capacities differ by about the largest cell, so
the j-th cut lies in a window of some 2j cells: a round opens at most about shards^2 of them (fewer than exist in the
first round, ``2 ** TOP_BITS``) and sums ``2 ** STEP_BITS`` as many, whatever the number of groups. Meant for up to some
hundreds of shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import hash_salt, read_table, salts_for, stage

OVERHEAD = 16
TOP_BITS = 12
STEP_BITS = 5


@dataclass(frozen=True)
class Cell:
    """A range of hash positions: ``key`` is its first position as an unsigned 64-bit number."""

    key: int
    bits: int
    size: int
    groups: int
    largest: int


def feasible(sizes: list[int], capacity: int, shards: int) -> bool:
    """Greedy check with each size as one piece."""
    used, room = 0, 0
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
            if used > shards:
                return False
        room -= s
    return True


def feasible_divisible(cells: list[Cell], capacity: int, shards: int) -> bool:
    """Greedy check in which cells of several groups may be cut anywhere: false only if no exact packing exists."""
    used, room = 0, 0
    for c in cells:
        if c.groups == 1:
            if c.size > capacity:
                return False
            if c.size > room:
                used, room = used + 1, capacity
            room -= c.size
        else:
            left = c.size - room
            if left <= 0:
                room -= c.size
                continue
            more = -(-left // capacity)
            used, room = used + more, more * capacity - left
        if used > shards:
            return False
    return used <= shards


def _least(ok, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if ok(mid):
            high = mid
        else:
            low = mid + 1
    return low


def search(cells: list[Cell], shards: int) -> tuple[int, int]:
    """(capacity below which nothing works, capacity that works on whole cells)."""
    total, sizes = sum(c.size for c in cells), [c.size for c in cells]
    low = max(-(-total // shards), max(c.largest for c in cells))
    low = _least(lambda c: feasible_divisible(cells, c, shards), low, max(low, total))
    return low, _least(lambda c: feasible(sizes, c, shards), low, max(low, total))


def cut_windows(cells: list[Cell], low: int, high: int, shards: int) -> list[int]:
    """Indexes of cells in which some cut of a capacity from ``low`` to ``high`` may fall."""
    starts, at = [], 0
    for c in cells:
        starts.append(at)
        at += c.size
    total, open_, first = at, set(), 0
    for j in range(1, shards):
        # greedy at `low`, giving up a whole cell at each cut, is never ahead of the true cut
        i = max(0, bisect_right(starts, first + low) - 1)
        first = max(starts[i], first)
        last = min(total, j * high)
        for k in range(max(0, bisect_right(starts, first) - 1), len(cells)):
            if starts[k] >= last:
                break
            if cells[k].groups > 1:
                open_.add(k)
        if first >= total:
            break
    return sorted(open_)


def balanced_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """First index of each shard after the first: no shard above ``capacity``, each as near to its even share as that allows."""
    n = len(sizes)
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    latest = [n] * (shards + 1)  # latest[j]: least start from which the shards from j on can take the rest
    for j in range(shards - 1, 0, -1):
        latest[j] = bisect_left(prefix, prefix[latest[j + 1]] - capacity, 0, latest[j + 1] + 1)
    cuts, at = [], 0
    for j in range(1, shards):
        goal = prefix[at] + (prefix[n] - prefix[at]) / (shards - j + 1)
        i = bisect_right(prefix, goal) - 1
        if i < n and prefix[i + 1] - goal < goal - prefix[i]:
            i += 1
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        at = min(max(i, at, latest[j]), most)
        cuts.append(at)
    return cuts


def _cells(groups: DataFrame, bits: int, parents: list[Cell] | None, parent_bits: int) -> list[Cell]:
    """Sums of groups by the first ``bits`` of the position, within ``parents`` (a bounded list) or everywhere."""
    top = lambda n: F.shiftright(F.col("gkey"), 64 - n)  # noqa: E731  arithmetic shift keeps signed order
    rows = groups
    if parents is not None:
        keys = [(c.key >> (64 - parent_bits)) - (1 << (parent_bits - 1)) for c in parents]
        rows = groups.where(top(parent_bits).isin(keys))
    got = rows.groupBy(top(bits).alias("k")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).collect()
    return sorted((Cell((r["k"] + (1 << (bits - 1))) << (64 - bits), bits, r["s"], r["n"], r["m"]) for r in got), key=lambda c: c.key)


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the hash (signed) at which each later shard starts.

    ``groups``: gkey long, size long, one row for each atomic group.
    """
    cells = _cells(groups, TOP_BITS, None, 0)
    if not cells:
        return 0, []
    bits = TOP_BITS
    low, high = search(cells, shards)
    while low < high:
        chosen = [cells[i] for i in cut_windows(cells, low, high, shards)]
        chosen = [c for c in chosen if c.bits == bits] or [c for c in cells if c.groups > 1 and c.bits == bits]
        if not chosen or bits >= 60:
            break
        finer = _cells(groups, bits + STEP_BITS, chosen, bits)
        gone = {c.key for c in chosen}
        cells = sorted([c for c in cells if c.key not in gone or c.bits != bits] + finer, key=lambda c: c.key)
        bits += STEP_BITS
        low, high = search(cells, shards)
    cuts = balanced_cuts([c.size for c in cells], high, shards)
    ends = [cells[i].key if i < len(cells) else None for i in cuts]
    return high, [None if k is None else k - (1 << 63) for k in ends]


def minimax_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of (gkey long, size long, doc_id, ...).

    Rows of one gkey stay together. Slots count each shard's rows without gaps; they are dealt through even cells
    (shard, salt of doc_id), so that no shard and no group is numbered by one task. Equal rows are interchangeable.
    An empty table gives no rows.
    """
    base = stage(rows, "shard-rows")
    groups = stage(base.groupBy("gkey").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    _, starts = capacity_and_cuts(groups, shards)
    shard = F.lit(0)
    for s in starts:  # at most shards - 1 comparisons
        if s is not None:
            shard = shard + (F.col("gkey") >= F.lit(s)).cast("int")
    most = groups.groupBy(shard.alias("s")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0  # rows of the fullest shard
    placed = base.withColumn("shard", shard.cast("int")).withColumn("_salt", hash_salt(salts_for(most), "doc_id", "gkey"))
    sums = placed.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = sums.select("shard", "_salt", F.expr("sum(_n) over (partition by shard order by _salt) - _n").alias("_before"))
    # at most shards x salts rows
    ranked = placed.withColumn("_rank", F.expr("row_number() over (partition by shard, _salt order by doc_id, gkey, size)"))
    return ranked.join(F.broadcast(before), ["shard", "_salt"]).withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_salt", "_before", "_rank")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents over shards of near-equal bytes; equal texts share a shard.

    Size: UTF-8 bytes of the text plus 16. A null text counts as an empty one (16 bytes, crc32 of no bytes, and the
    same group as empty texts). Null and repeated ids are ordinary rows. Other columns are ignored. A group above the
    even share (one text with a third of all bytes) sets the capacity and the other shards share the rest evenly.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("gkey")
    )
    return minimax_shards(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
