"""Link graph analytics: degrees, exclusion, rank, levels, contributors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.annotate import digest
from kgspark.operators.predicates import Condition, all_of, any_of
from kgspark.session import known_path, stage
from kgspark.sources.adjacency import select_provider

DAMPING, ROUNDS, TOLERANCE = 0.85, 20, 1e-7
SMALL = 25
#: The fields and values that leave a note out of ranking unless the caller says otherwise.
EXCLUDE_FIELD = "mycelium_exclude"
EXCLUDE_TYPES = ["generated", "archive", "index", "log"]
DEFAULT_EXCLUDE = (Condition(EXCLUDE_FIELD, "equals", True), Condition("node_type", "in", EXCLUDE_TYPES))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vault, node, in_degree, out_degree, ratio): distinct neighbours, zero where none."""
    into = edges.groupBy("vault", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"))
    out = edges.groupBy("vault", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_degree"))
    rows = nodes.join(into, ["vault", "node"], "left").join(out, ["vault", "node"], "left").fillna(0, ["in_degree", "out_degree"])
    return rows.withColumn("ratio", F.col("in_degree") / F.greatest("out_degree", F.lit(1)))


def excluded(notes: DataFrame, where: list[Condition] | None = None) -> DataFrame:
    """(vault, node) left out of ranking: any default condition, or all of ``where``; an empty list leaves out nothing."""
    if where is None:
        hit: Column = any_of(DEFAULT_EXCLUDE)
    else:
        hit = all_of(where) if where else F.lit(False)
    return notes.where(hit).select("vault", F.col("path").alias("node"))


def prune(nodes: DataFrame, edges: DataFrame, out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the excluded ones, and edges whose both ends remain."""
    kept = nodes.join(out, ["vault", "node"], "left_anti")
    ends = lambda side: kept.select("vault", F.col("node").alias(side))
    return kept, edges.join(ends("src"), ["vault", "src"], "left_semi").join(ends("dst"), ["vault", "dst"], "left_semi")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, cut_every: int = 5) -> DataFrame:
    """(vault, node, rank) over unique unweighted edges, each vault by itself; dangling rank is spread evenly.

    Stops after the first round in which no vault changed by ``tolerance`` in all. A round is a join and a sum over
    edges; one small sum a vault gives both its change and the dangling rank of the next round. Nodes without any edge
    have the same rank in a vault: they are one number of it, and rounds work on the others. Rounds are kept in
    memory where there is room, and every ``cut_every`` of them the ranks are written to the shared folder, so that a
    lost executor costs a few rounds at most.
    """
    links = stage(edges.select("vault", "src", "dst").distinct(), "rank-edges")
    outs = links.groupBy("vault", F.col("src").alias("node")).agg(F.count("*").alias("outs"))
    ends = links.select("vault", F.col("src").alias("node")).unionByName(links.select("vault", F.col("dst").alias("node"))).distinct().withColumn("linked", F.lit(True))
    every = stage(nodes.select("vault", "node").join(outs, ["vault", "node"], "left").join(ends, ["vault", "node"], "left"), "rank-nodes")
    sizes = {r["vault"]: r for r in every.groupBy("vault").agg(F.count("*").alias("n"), F.count(F.when(F.col("linked").isNull(), 1)).alias("alone")).collect()}  # a row a vault
    of_vault = lambda values: F.create_map(*[x for v, y in values.items() for x in (F.lit(v), F.lit(y))])[F.col("vault")]
    base, moved = {v: 1 / r["n"] for v, r in sizes.items()}, dict.fromkeys(sizes, 1.0)  # rank and change of a node without edges
    if not sizes:
        return every.select("vault", "node", F.lit(0.0).alias("rank"))
    rank = every.where("linked").select("vault", "node", "outs", of_vault(base).alias("rank"), F.lit(1.0).alias("change"))
    sums = [F.sum("change").alias("change"), F.coalesce(F.sum(F.when(F.col("outs").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")]
    kept: list[DataFrame] = []
    for k in range(1, rounds + 1):
        state = {r["vault"]: r for r in rank.groupBy("vault").agg(*sums).collect()}
        own = lambda v, what: (state[v][what] if v in state else 0.0) + sizes[v]["alone"] * (moved if what == "change" else base)[v]  # noqa: B023, E731
        if max(own(v, "change") for v in sizes) < tolerance:
            break
        new_base = {v: (1 - damping) / r["n"] + damping * own(v, "loose") / r["n"] for v, r in sizes.items()}
        base, moved = new_base, {v: abs(x - base[v]) for v, x in new_base.items()}
        share = rank.where("outs is not null").select("vault", F.col("node").alias("src"), (F.col("rank") / F.col("outs")).alias("part"))
        got = links.join(share, ["vault", "src"]).groupBy("vault", F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        new = of_vault(base) + damping * F.coalesce("got", F.lit(0.0))
        rank = rank.join(got, ["vault", "node"], "left").select("vault", "node", "outs", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        if k % cut_every and k < rounds:
            rank = rank.persist()
            kept.append(rank)
        else:
            rank = stage(rank, "rank")
            while kept:
                kept.pop().unpersist()
    if kept:
        rank = stage(rank, "rank")
        while kept:
            kept.pop().unpersist()
    return rank.select("vault", "node", "rank").unionByName(every.where("linked is null").select("vault", "node", of_vault(base).alias("rank")))


def cuts(values: DataFrame, at: tuple[float, ...], column: str = "rank", key: str = "vault", per_octave: int = 64) -> DataFrame:
    """(key, top, n, p): exact interpolated percentiles of a positive column, with its largest value and count.

    Values are counted first, equal ones as one row, then summed by parts of an octave; only the parts that hold a
    wanted place are ranked. So no task holds a key's values.
    """
    part = F.floor(F.log2(F.greatest(column, F.lit(1e-300))) * per_octave).cast("int")
    counts = stage(values.groupBy(key, part.alias("part"), F.col(column).alias("v")).agg(F.count("*").alias("c")), "cut-counts")
    parts = counts.groupBy(key, "part").agg(F.sum("c").alias("c"), F.max("v").alias("top"))
    line, whole = Window.partitionBy(key).orderBy("part"), Window.partitionBy(key)  # some thousand parts at most
    parts = parts.select(key, "part", (F.sum("c").over(line) - F.col("c")).alias("before"), "c", F.sum("c").over(whole).alias("n"), F.max("top").over(whole).alias("top"))
    place = lambda p, side: side(F.lit(p) * (F.col("n") - 1)).cast("long")
    wanted = F.array_distinct(F.array(*[place(p, side) for p in at for side in (F.floor, F.ceil)]))
    some = parts.select("*", F.explode(wanted).alias("place")).where("place >= before and place < before + c").select(key, "part", "before", "n", "top", "place")
    hit = some.select(key, "part", "before").distinct()
    inner = Window.partitionBy(key, "part").orderBy("v")
    ranked = counts.join(hit, [key, "part"]).withColumn("upto", F.col("before") + F.sum("c").over(inner)).select(key, "part", "v", "upto", (F.col("upto") - F.col("c")).alias("from"))
    found = some.join(ranked, [key, "part"]).where("place >= from and place < upto")
    found = found.groupBy(key).agg(F.max("top").alias("top"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))
    value = lambda p: F.col("at")[place(p, F.floor)] + (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))) * (F.col("at")[place(p, F.ceil)] - F.col("at")[place(p, F.floor)])
    return found.select(key, "top", "n", F.array(*[value(p) for p in at]).alias("p"))


def levels(ranked: DataFrame, in_degree: DataFrame) -> DataFrame:
    """Add ``level`` 0 ... 5: percentile cuts of rank in large vaults, shares of the largest in small ones, leaves 5."""
    rows = ranked.join(F.broadcast(cuts(ranked, (0.5, 0.8, 0.95, 0.99))), "vault")  # a row a vault
    rows = rows.join(in_degree, ["vault", "node"], "left").fillna(0, ["in_degree"])
    r, p, share = F.col("rank"), F.col("p"), F.col("rank") / F.col("top")
    large = F.when(r >= p[3], 0).when(r >= p[2], 1).when(r >= p[1], 2).when(r >= p[0], 3).otherwise(4)
    small = F.when(share >= 0.75, 0).when(share >= 0.5, 1).when(share >= 0.3, 2).when(share >= 0.15, 3).otherwise(4)
    level = F.when(F.col("in_degree") == 0, 5).when(F.col("n") <= SMALL, small).otherwise(large)
    return rows.select("vault", "node", "rank", level.alias("level"))


def signals(notes: DataFrame, edges: DataFrame, where: list[Condition] | None = None) -> DataFrame:
    """(vault, node, in_degree, out_degree, ratio, rank, level, excluded): degrees of the whole graph, rank and level of the pruned one.

    Notes are parsed and links resolved once: what both come to is written before it is read again and again.
    """
    nodes, out = stage(notes.select("vault", F.col("path").alias("node")), "signal-nodes"), stage(excluded(notes, where), "signal-excluded")
    edges = stage(edges.select("vault", "src", "dst"), "signal-edges")
    kept, pruned = prune(nodes, edges, out)
    kept, pruned = stage(kept, "signal-kept"), stage(pruned, "signal-pruned")
    inner = pruned.groupBy("vault", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"))
    banded = levels(pagerank(kept, pruned), inner)
    rows = degrees(nodes, edges).join(banded, ["vault", "node"], "left")
    return rows.join(out.withColumn("excluded", F.lit(True)), ["vault", "node"], "left").fillna(False, ["excluded"])


def kept_signals(notes: DataFrame, edges: Callable[[], DataFrame], root: str, where: list[Condition] | None = None, given: DataFrame | None = None, status: str = "available") -> DataFrame:
    """``signals``, kept in ``root`` and worked out once for the same notes, exclusion and graph.

    The graph is ``given`` (vault, src, dst, cnt) where it can be had, else ``edges()``, which follow from the notes and
    are only asked for where nothing is kept yet. The key holds the digest of all notes, the exclusion, which of the two
    it is and why, and the digest of given edges. Rows count as kept once the receipt beside them is written.
    """
    spark = notes.sparkSession
    _, receipt = select_provider(None, given, status)
    sums = digest(notes, ["vault"]).orderBy("vault").collect()  # a row a vault
    links = digest(given.select("vault", F.concat_ws("\n", "src", "dst").alias("path"), F.col("cnt").cast("string").alias("raw")), ["vault"]).orderBy("vault").collect() if receipt["provider"] == "given" else []
    rules = "default" if where is None else json.dumps([asdict(c) for c in where], default=str, sort_keys=True)
    key = [[[r["vault"], r["files"], r["digest"]] for r in rows] for rows in (sums, links)]
    name = hashlib.sha256(json.dumps([*key, receipt, rules], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/signals-{name}"
    done = known_path(lambda: spark.read.schema("n long").parquet(f"{path}/receipt"))
    if done is None or not done.limit(1).count():
        signals(notes, given if receipt["provider"] == "given" else edges(), where).write.mode("overwrite").parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/receipt")
    return spark.read.parquet(f"{path}/rows")


def histogram(banded: DataFrame, out: DataFrame | None = None) -> DataFrame:
    """(vault, level, n) with all six levels, zero where none; with ``out`` (vault, node) also level null, the excluded."""
    if out is not None:
        banded = banded.select("vault", "level").unionByName(out.select("vault", F.lit(None).cast("int").alias("level")))
    levels_ = F.array(*[F.lit(k) for k in range(6)], *([F.lit(None).cast("int")] if out is not None else []))
    vaults = banded.select(F.col("vault").alias("_v")).distinct().withColumn("_l", F.explode(levels_))
    counts = banded.groupBy("vault", "level").agg(F.count("*").alias("n"))
    rows = vaults.join(counts, (F.col("vault") == F.col("_v")) & F.col("level").eqNullSafe(F.col("_l")), "left")
    return rows.select(F.col("_v").alias("vault"), F.col("_l").alias("level"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def contributors(edges: DataFrame, ranked: DataFrame, most: int = 5) -> DataFrame:
    """(vault, dst, src, rank, place): each node's highest-ranked sources."""
    rows = edges.join(ranked.select("vault", F.col("node").alias("src"), "rank"), ["vault", "src"])
    best = Window.partitionBy("vault", "dst").orderBy(F.col("rank").desc(), "src")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("vault", "dst", "src", "rank", "place")
