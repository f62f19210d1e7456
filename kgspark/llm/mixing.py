"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Each source's documents lie in a seeded order on a line of its words, which is cut into blocks of equal numbers of
words. Seats (blocks of the mix) go to sources by the highest quotients target / (2 seats + 1), and the order in which
they are won deals them over the shards of the mix: an integer quota of each source for each shard. Then the shards, in
turn, take the blocks of their quotas from each source's blocks in a seeded order, which starts anew when all are taken.
Sources whose targets are few blocks have smaller ones, halved until a target is ``FINE`` blocks (or a block is a word),
and share the seats of their block size among themselves: every source comes out near its target, however small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import hash_salt, read_table, salts_for, stage

WEIGHTS = (5, 2, 1)
FINE = 512  # blocks of a target, at least, unless they are single words
GROUP = 64  # about so many small sources share seats
RANGES = 1024  # of sources, to number them
WORDS = r"[^\x20\x09-\x0D]+"


def numbered(sizes: DataFrame) -> DataFrame:
    """Add ``turn``, each source's place from 0 on by code point, null last.

    Sources are numbered within at most ``RANGES`` ranges, cut at a bounded sample of them, and the ranges' counts give
    the offsets: no task holds them all.
    """
    n = sizes.count()
    picked = sizes.where("source is not null").where(F.pmod(F.xxhash64(F.lit(13), "source"), F.lit(1 << 30)) < min(1.0, 8 * RANGES / max(1, n)) * (1 << 30))
    cuts = sorted(r["source"] for r in picked.select("source").collect()) if n > RANGES else []
    cuts = cuts[:: max(1, -(-len(cuts) // RANGES))][1:]
    side = max(1, math.isqrt(len(cuts)))
    among = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("source")))
    outer = cuts[side - 1 :: side]
    top = below(among(outer))
    inner = F.array(*[among(cuts[i * side : i * side + side - 1]) for i in range(len(outer) + 1)])
    range_ = F.when(F.col("source").isNull(), len(cuts) + 1).otherwise(top * side + below(F.element_at(inner, top + 1)))
    rows = sizes.withColumn("_range", range_.cast("int"))
    sums = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())  # RANGES + 1 rows at most
    before, at = [], 0
    for k, many in sums:
        before += [F.lit(k), F.lit(at).cast("long")]
        at += many
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    offset = F.create_map(*before)[F.col("_range")] if before else F.lit(0)
    return rows.withColumn("turn", rank + offset).drop("_range")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all sizes by repeating weights, none above ``most`` x size.

    The excess of stopped sources goes to the others by weight until none is above: each round sums the stopped
    sources and the weights of the others, which gives the others a new level, until no further source stops.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = stage(numbered(sizes).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("turn"), "mix-weights")
    stopped = lambda level: F.col("cap") < F.col("w") * F.lit(level)
    level, seen = 0.0, -1
    while True:
        got = rows.agg(
            F.sum("source_size").alias("all"), F.count(F.when(stopped(level), 1)).alias("n"),
            F.sum(F.when(stopped(level), F.col("cap"))).alias("cap"), F.sum(F.when(~stopped(level), F.col("w"))).alias("w"),
        ).first()
        if got["w"] is None or got["n"] == seen:
            break
        level, seen = (float(got["all"]) * share - (got["cap"] or 0.0)) / got["w"], got["n"]
    target = F.col("cap") if got["w"] is None else F.least("cap", F.col("w") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def won_seats(rows: DataFrame) -> DataFrame:
    """(source, seat, turn, n): the ``n`` highest quotients target / (2 seat + 1) of each (tier, part), in the order they are won.

    A source's seats are within one of its even share or a little above, so only quotients up to twice that are made:
    about twice ``n`` rows and two a source.
    """
    part = Window.partitionBy("tier", "part")
    rows = rows.where("target > 0").withColumn("share", F.col("target") * F.col("n") / F.sum("target").over(part))
    rows = rows.select("source", "target", "tier", "part", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("share") * 2).cast("int") + 1)).alias("seat"))
    quotient = F.col("target") / (2 * F.col("seat") + 1)
    rows = rows.withColumn("turn", F.row_number().over(part.orderBy(quotient.desc(), F.col("source").asc_nulls_last(), "seat")) - 1)
    return rows.where(F.col("turn") < F.col("n")).select("source", "seat", "turn", "n")


def seats(targets: DataFrame, n_seats: int) -> DataFrame:
    """(source, seat, turn): ``n_seats`` seats shared by all sources."""
    return won_seats(targets.withColumns({"tier": F.lit(0), "part": F.lit(0), "n": F.lit(n_seats)})).drop("n")


def with_blocks(targets: DataFrame, n_seats: int) -> DataFrame:
    """Add block (words), n_blocks, tier, part and n (seats of the tier and part) to targets.

    Tier 0 has blocks of all targets / ``n_seats``, each further tier half of that. A tier above 0 is dealt in parts of
    about ``GROUP`` sources, so no task holds more seats than some ``n_seats`` or ``GROUP`` x 2 x ``FINE``.
    """
    total, many = targets.agg(F.sum("target"), F.count("*")).first()
    n_seats = max(1, min(n_seats, round(total or 0.0)))  # a block has a word at least
    block = max((total or 0.0) / n_seats, 1.0)
    halved = F.ceil(F.log2(F.lit(FINE * block) / F.greatest("target", F.lit(1e-9))))
    tier = F.greatest(F.least(halved, F.lit(math.ceil(math.log2(block)))), F.lit(0)).cast("int")
    rows = targets.withColumn("tier", tier).withColumn("block", F.greatest(F.lit(block) / F.pow(F.lit(2.0), "tier"), F.lit(1.0)))
    rows = rows.withColumn("n_blocks", F.greatest(F.round(F.col("source_size") / F.col("block")), F.lit(1.0)).cast("long"))
    rows = rows.withColumn("part", F.when(F.col("tier") > 0, hash_salt(-(-many // GROUP) or 1, "source")).otherwise(0))
    return rows.withColumn("n", F.round(F.sum("target").over(Window.partitionBy("tier", "part")) / F.col("block")).cast("long"))


def shard_quotas(blocks: DataFrame, mix_shards: int) -> DataFrame:
    """(source, mix_shard, quota): seats that each source won in each shard of the mix. The seats of a tier and part are
    dealt over the shards in the order they were won, so every shard's mixture is near the whole one's."""
    shard = F.floor(F.col("turn") * mix_shards / F.col("n")).cast("int")
    return won_seats(blocks).groupBy("source", shard.alias("mix_shard")).agg(F.count("*").alias("quota"))


def mix_plan(targets: DataFrame, n_seats: int, mix_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of sources as of ``with_blocks``, chosen (source, mix_shard, block): the blocks that fill the quotas).

    The shards' quotas follow each other on a source's seeded order of its blocks: a shard starts where the one before it
    stopped, and behind the last block the order starts anew. A block is taken at most twice, as no document may be
    taken more often: the seat or two that rounding may give a source beyond twice its blocks stay empty.
    """
    blocks = stage(with_blocks(targets, n_seats), "mix-blocks")
    quotas = shard_quotas(blocks, mix_shards)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("mix_shard"))  # mix_shards rows a source at most
    quotas = quotas.withColumn("first", upto - F.col("quota")).select(F.col("source").alias("_s"), "mix_shard", "quota", "first")
    own = blocks.select("source", "n_blocks")
    seat = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("seat")
    taken = quotas.join(own, quotas["_s"].eqNullSafe(own["source"])).select("source", "n_blocks", "mix_shard", seat).where("seat < 2 * n_blocks")
    taken = taken.select(F.col("source").alias("_s"), "mix_shard", (F.col("seat") % F.col("n_blocks") + 1).alias("_lot"))
    lots = own.join(taken.select(F.col("_s")).distinct(), own["source"].eqNullSafe(F.col("_s")), "left_semi")
    lots = lots.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    lots = lots.withColumn("_h", F.xxhash64(F.lit(seed), "source", "block")).withColumn("_part", F.shiftright("_h", 56))
    lots = with_sum_before(lots.withColumn("_one", F.lit(1).cast("long")), "_part", "_one")
    within = Window.partitionBy("source", "_part").orderBy("_h", "block")
    lots = lots.select("source", "block", (F.row_number().over(within) + F.col("_before")).alias("lot"))
    chosen = lots.join(taken, lots["source"].eqNullSafe(taken["_s"]) & (lots["lot"] == taken["_lot"])).select("source", "mix_shard", "block")
    return blocks, stage(chosen, "mix-chosen")


def with_sum_before(rows: DataFrame, part: str, value: str) -> DataFrame:
    """Add ``_before``, the sum of ``value`` over the source's rows in lower parts. A source has at most some 256 parts,
    so a running sum over a source is one over its parts and one within each: no task numbers a hot source's blocks."""
    sums = rows.groupBy(F.col("source").alias("_s"), F.col(part).alias("_p")).agg(F.sum(value).alias("_v"))
    line = Window.partitionBy("_s").orderBy("_p")
    sums = sums.select("_s", "_p", (F.sum("_v").over(line) - F.col("_v")).alias("_before"))
    return rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows[part] == sums["_p"])).drop("_s", "_p")


def words_ahead(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(source, k, sum): words of the chosen blocks ahead of block k, repeats counted; k = n_blocks gives all of them."""
    times = chosen.groupBy(F.col("source").alias("_s"), F.col("block").alias("_k")).agg(F.count("*").alias("times"))
    line = blocks.select("source", "source_size", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks"))).alias("k"))
    line = line.join(times, line["source"].eqNullSafe(times["_s"]) & (line["k"] == times["_k"]), "left")
    edge = lambda k: F.floor(k * F.col("source_size") / F.col("n_blocks"))
    line = line.withColumn("words", F.coalesce("times", F.lit(0)) * (edge(F.col("k") + 1) - edge(F.col("k"))))
    line = line.select("source", "k", F.coalesce("times", F.lit(0)).alias("times"), "words", F.floor(F.col("k") / F.ceil((F.col("n_blocks") + 1) / 256)).alias("_part"))
    within = Window.partitionBy("source", "_part").orderBy("k")
    line = with_sum_before(line, "_part", "words")
    return line.select("source", "k", "times", (F.col("_before") + F.sum("words").over(within) - F.col("words")).alias("sum"))


def block_of(x) -> tuple:
    """The block that holds word x of the source's line (the last one for its end), and the block's first word."""
    k = F.floor((x * F.col("n_blocks") + F.col("n_blocks") - 1) / F.greatest("source_size", F.lit(1)))
    k = F.least(F.greatest(k, F.lit(0)), F.col("n_blocks") - 1)
    start = lambda b: F.floor(b * F.col("source_size") / F.col("n_blocks"))
    k = F.when(start(k) > x, k - 1).otherwise(k)
    return k, start(k)


def mix_sources(
    rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, n_seats: int = 65_536, mix_shards: int = 64, seed: int = 11
) -> DataFrame:
    """Add source_size, target, taken, copies to rows of (doc_id, source, size, ...).

    ``taken``: words that the chosen blocks hold of the document, repeats counted. ``copies``: the whole-document
    reading of it: how often the block that holds its middle word was chosen. Running positions within a source come
    from sums over even cells (source, salt), so a source with a third of all rows is spread. A cell carries the blocks
    that it touches, so documents meet their plan in the join that places them; nothing is broadcast by force and
    nothing of a size that grows with the sources meets in one task. ``n_seats`` sets the blocks of large sources, which
    bounds those of any one source. Equal rows are interchangeable; reruns agree.
    """
    base = stage(rows, "mix-rows")
    stats = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    stats = stage(stats, "mix-sources")
    largest = stats.agg(F.max("n")).first()[0] or 0
    targets = stage(source_targets(stats.select("source", "source_size"), weights, share, most), "mix-targets")
    plan, chosen = mix_plan(targets, n_seats, mix_shards, seed)

    cells = base.withColumn("_salt", hash_salt(salts_for(largest, 64, 4096), *rows.columns))
    line = Window.partitionBy("source", "_salt").orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)
    sums = cells.groupBy("source", "_salt").agg(F.sum("size").alias("_words"))
    sums = sums.withColumn("_at", F.sum("_words").over(Window.partitionBy("source").orderBy("_salt")) - F.col("_words"))
    sums = sums.select(F.col("source").alias("_s"), F.col("_salt").alias("_t"), "_at", "_words")
    facts = ["source_size", "target", "n_blocks"]
    sums = sums.join(plan.select("source", *facts), sums["_s"].eqNullSafe(F.col("source"))).drop("source")
    sums = sums.withColumn("_k0", block_of(F.col("_at"))[0])
    sums = sums.withColumn("_k", F.explode(F.sequence("_k0", block_of(F.col("_at") + F.col("_words"))[0] + 1)))
    ahead = words_ahead(plan, chosen)
    sums = sums.join(ahead, sums["_s"].eqNullSafe(ahead["source"]) & (sums["_k"] == ahead["k"]))
    before = F.sort_array(F.collect_list(F.struct("k", "sum", "times"))).alias("before")
    sums = sums.groupBy("_s", "_t", "_at", "_k0", *facts).agg(before)
    placed = cells.withColumn("_in", F.sum("size").over(line) - F.col("size"))
    out = placed.join(sums, placed["source"].eqNullSafe(sums["_s"]) & (placed["_salt"] == sums["_t"])).withColumn("_from", F.col("_at") + F.col("_in"))

    def at(k):
        return F.element_at("before", (k - F.col("_k0") + 1).cast("int"))

    def chosen_before(x):
        k, start = block_of(x)
        return at(k)["sum"] + at(k)["times"] * (x - start)

    end = F.col("_from") + F.col("size")
    middle_block, _ = block_of(F.col("_from") + F.floor(F.col("size") / 2))
    taken = chosen_before(end) - chosen_before(F.col("_from"))
    out = out.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long"))
    out = out.withColumn("copies", at(middle_block)["times"].cast("long"))
    return out.drop("_salt", "_in", "_s", "_t", "_at", "_from", "_k0", "n_blocks", "before")


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each document.

    Size: words of the text (null: 0). Null sources form one source, the last. Documents without words take nothing.
    Null and repeated ids are ordinary rows: a row's place in its source's order comes from its id, size and text.
    Texts of any length count whole; other columns are ignored. An empty table gives no rows.
    """
    rows = with_size(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("_h"))
    return mix_sources(rows, **options).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself. A document comes as often as its chosen blocks say: not at all, once or twice.

    Rows are known by id and text, null ids too; rows that share both share the largest number of copies among them.
    Documents without words are never chosen. Columns of any name travel along; an empty table gives no rows.
    """
    hash_ = F.xxhash64(F.lit(31), "text")
    mixed = mix_sources(with_size(docs).select("doc_id", "source", "size", hash_.alias("_h"))).where("size > 0")
    copies = mixed.groupBy(F.col("doc_id").alias("_id"), "_h").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), hash_.alias("_own_h"))
    out = out.join(copies, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_h") == F.col("_h")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))
