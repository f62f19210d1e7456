"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into m groups of bits, correlated bits together. If the groups' thresholds add up to
radius - m + 1, two fingerprints within the radius agree within the threshold in some group; a threshold of -1 skips
a group. Dynamic programming picks thresholds by estimated candidates, over a bounded sample; whatever it picks, the
result is exact. Fingerprints are probed by all values within the threshold and verified by all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.bits import hex16, majority, vote_sums
from kgspark.llm.common import read_table, stage
from kgspark.llm.graph import components

SHINGLE = 4
RADIUS = 4
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
ROW_COST, PAIR_COST, PROBES = 1.5e-6, 4e-9, 2000  # seconds to ship a row and to verify a pair; most probes a group


def text_hash() -> Column:
    return F.xxhash64(F.lit(31), "text")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): a row for each row of ``docs``. Null and wordless texts have fingerprint zero."""
    text = F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text_hash().alias("text_hash"), F.array_remove(F.split(text, SPACE), "").alias("w"))
    at = lambda i: F.concat_ws(" ", *[F.element_at("w", (i + k).cast("int")) for k in range(1, size + 1)])
    shingles = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(at(i))))
    short = F.when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " "))))
    terms = rows.select("doc_id", "_row", "text_hash", F.explode_outer(F.coalesce(shingles, short)).alias("h"))
    sums = terms.groupBy("doc_id", "_row").agg(F.first("text_hash").alias("text_hash"), F.count("h").alias("n"), *vote_sums("h"))
    return sums.select("doc_id", "text_hash", F.coalesce(majority("n"), F.lit(0).cast("long")).alias("fp"))


@dataclass(frozen=True)
class Group:
    mask: int
    threshold: int

    def flips(self) -> list[int]:
        bits = [1 << b for b in range(64) if self.mask >> b & 1]
        return [sum(c) for k in range(self.threshold + 1) for c in combinations(bits, k)]


def correlated_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of even sizes, each grown by the bit most correlated with those it has."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        pool = sorted(left)
        own = [max(pool, key=lambda b: (corr[b, pool].max(), -b))]
        left.discard(own[0])
        while len(own) < size:
            pool = sorted(left)
            own.append(pool[int(corr[np.ix_(pool, own)].sum(1).argmax())])
            left.discard(own[-1])
        groups.append(sorted(own))
    return groups


def within_chance(bits: np.ndarray, group: list[int], radius: int, pairs: int = 200_000) -> np.ndarray:
    """Chance that two fingerprints differ in at most e bits of the group, e = 0 ... radius.

    The larger of what random pairs of the sample show and what the bits give if they were independent.
    """
    part = bits[:, group]
    p = part.mean(0)
    dist = np.zeros(radius + 2)
    dist[0] = 1
    for differ in 2 * p * (1 - p):
        dist[1:] = dist[1:] * np.append(np.full(radius, 1 - differ), 1) + dist[:-1] * differ
        dist[0] *= 1 - differ
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(bits), (2, pairs))
    apart = (part[a] != part[b]).sum(1)[a != b]
    seen = np.array([(apart <= e).mean() if len(apart) else 0 for e in range(radius + 1)])
    return np.maximum(seen, np.cumsum(dist[: radius + 1]))


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds (one a row of ``costs``, column e + 1 for threshold e) that add up to ``total`` at least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for e in range(-1, len(row) - 1):
                cost = c + row[e + 1]
                if math.isfinite(cost) and (s + e not in nxt or cost < nxt[s + e][0]):
                    nxt[s + e] = (cost, [*chosen, e])
        best = nxt
    return best.get(total, (math.inf, []))


def plan_groups(sample: np.ndarray, n: int, radius: int = RADIUS, most_groups: int = 6) -> list[Group]:
    """Groups and thresholds of least estimated cost for n distinct fingerprints."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int8) if len(sample) else np.zeros((1, 64), np.int8)
    best: tuple[float, list[Group]] = (math.inf, [])
    for m in range(2, most_groups + 1):
        groups = correlated_groups(bits, m)
        costs = np.full((m, radius + 2), math.inf)
        costs[:, 0] = 0
        for g, group in enumerate(groups):
            chance = within_chance(bits, group, radius)
            for e in range(radius + 1):
                probes = sum(math.comb(len(group), k) for k in range(e + 1))
                if probes <= PROBES:
                    costs[g, e + 1] = n * probes * ROW_COST + n * n / 2 * chance[e] * PAIR_COST
        cost, thresholds = allocate(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, [Group(sum(1 << b for b in group), t) for group, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def link_run(fp: np.ndarray, owners: int, radius: int, small: int = 1 << 20) -> list[np.ndarray]:
    """Links of one bucket, enough to connect all that are connected: (2, k) arrays.

    The first ``owners`` have the bucket's own value, the others probe it: an owner is compared with everything, a
    probe with owners. A large bucket is searched from link to link, and what is connected already isn't compared
    again, so copies by the thousand cost one pass.
    """
    n = len(fp)
    if owners * (n - owners) + owners * owners // 2 <= small:
        a, b = np.nonzero(np.triu(np.ones((owners, n), dtype=bool), 1))
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        return [np.stack([fp[a[near]], fp[b[near]]])]
    out, own, probe = [], fp[:owners], fp[owners:]
    while len(own):
        queue, own = [(own[0], True)], own[1:]
        while queue:
            x, is_owner = queue.pop()
            hit = np.bitwise_count(own ^ x) <= radius
            found, own = own[hit], own[~hit]
            queue += [(y, True) for y in found]
            out.append(np.stack([np.full(len(found), x), found]))
            if is_owner:
                hit = np.bitwise_count(probe ^ x) <= radius
                found, probe = probe[hit], probe[~hit]
                queue += [(y, False) for y in found]
                out.append(np.stack([np.full(len(found), x), found]))
    return out


def link_sorted(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, radius: int, block: int = 1 << 21) -> np.ndarray:
    """Links of rows sorted by key, owners before probes: pairs of small buckets all at once, large buckets one by one."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    end = np.append(first[1:], len(key))
    owners = np.add.reduceat((~probe).astype(np.int64), first) if len(key) else np.zeros(0, int)
    pairs = owners * (end - first - owners) + owners * (owners - 1) // 2
    out = []
    for k in np.flatnonzero(pairs > block):
        out += link_run(fp[first[k] : end[k]], int(owners[k]), radius)
    some = np.flatnonzero((pairs > 0) & (pairs <= block))
    at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(owners[some])[:-1]]), owners[some]) + np.arange(int(owners[some].sum()))
    partners = np.repeat(end[some], owners[some]) - at - 1  # an owner meets all behind it
    cum = np.cumsum(partners)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + block, side="right")))
        p = partners[lo:hi]
        a = np.repeat(at[lo:hi], p)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(p) - p, p)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        out.append(np.stack([fp[a[near]], fp[b[near]]]))
        lo = hi
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), fp.dtype)


def near_links(fps: DataFrame, radius: int = RADIUS, sample_rows: int = 8192, heavy: int = 1 << 22) -> DataFrame:
    """(a, b) links of distinct fingerprints ``fp`` within ``radius`` bits, enough to connect all that are connected.

    The sample only shapes the plan. Equal fingerprints are one row, and a bucket's rows (17 bytes each) meet in one
    task. A bucket of over ``heavy`` rows is cut into parts instead, and every two parts meet in a task of their own, so
    that no task holds more than about 2 x ``heavy`` rows and no two rows are kept apart. Buckets that heavy are at most
    rows / ``heavy``, which bounds what is broadcast.
    """
    rows = fps.orderBy(F.xxhash64("fp")).limit(sample_rows).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    n = fps.count() if len(rows) == sample_rows else len(rows)
    groups = plan_groups(sample, n, radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    probes = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(signed(g.mask)).cast("long").alias("mask"), F.array(*[F.lit(signed(f)).cast("long") for f in g.flips()]).alias("flips")) for i, g in enumerate(groups)])
    keyed = fps.select("fp", F.explode(probes).alias("g")).select("fp", "g.part", "g.mask", F.explode("g.flips").alias("flip"))
    keyed = keyed.select("part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") != 0).alias("probe"), "fp")
    keyed = keyed.withColumn("tile", F.lit(0).cast("long"))
    if n > heavy:  # no bucket has more rows than there are fingerprints
        many = keyed.groupBy("part", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy)
        keyed = keyed.join(F.broadcast(many), ["part", "value"], "left").withColumn("_parts", F.coalesce(F.ceil(F.col("_n") / heavy), F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(41), "fp"), F.col("_parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        keyed = keyed.withColumn("_own", own).withColumn("_other", other)
        keyed = keyed.withColumn("tile", F.least("_own", "_other") * F.col("_parts") + F.greatest("_own", "_other")).drop("_n", "_parts", "_own", "_other")
    keyed = keyed.select("part", "value", "tile", "probe", "fp")
    keyed = keyed.repartition("part", "value", "tile").sortWithinPartitions("part", "value", "tile", "probe", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def of(parts: list[tuple]) -> pa.RecordBatch:
            value, probe, fp = (np.concatenate(x) for x in zip(*parts))
            a, b = link_sorted(value, probe, fp, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            part, value, tile, fp = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2, 4))
            probe = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            # equal values of different groups of bits must not touch: all three belong to the key
            key = np.stack([part, value, tile], axis=1)
            new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            key = key.view([("p", np.int64), ("v", np.int64), ("t", np.int64)]).ravel()
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                yield of(held)
                held = []
            if len(new):
                last = int(new[-1])
                yield of([*held, (key[:last], probe[:last], fp[:last].view(np.uint64))])
                held = [(key[last:], probe[last:], fp[last:].view(np.uint64))]
            else:
                held.append((key, probe, fp.view(np.uint64)))
        if held:
            yield of(held)

    return keyed.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link within ``radius`` bits, through any chain, share the smallest id.

    Null and wordless texts have fingerprint zero and link like any other. Null ids take part, but the id of a component
    is the smallest one that isn't null (null if there is none). Repeated rows each give a row; an empty table none.
    Extra columns don't matter.
    """
    rows = stage(fingerprints(docs, size), "simhash-rows")
    ids = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = components(near_links(ids.select("fp"), radius))
    # written before they are joined again: a hot root is then one side of a plain join, which adaptive execution splits
    named = stage(ids.join(roots, ids["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, rows["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id")


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
