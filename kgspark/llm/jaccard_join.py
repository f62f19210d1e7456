"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles.

Shingles have one order for all documents: rare ones first, by a sketch of counts over the whole corpus, then by hash. A
document of n shingles has at least ``least(n)`` in common with any partner, so its first n - least(n) + m shingles, its
m-fold prefix, and the prefix of a partner share m of them. Each document lengthens its prefix, and so raises m, by what
it would cost: rows read from its shingles' lists against partners left to verify. Two prefixes of any lengths must
share ``overlap(a, b) - max(rest a, rest b)`` shingles (rest: what is behind the prefix), or the pair isn't verified.

Groups of copies would make all their pairs. So equal sets are one node; then every node is compared with a leader of
its lists, and nodes that verify join the leader's star. Lists hold a row a star afterwards. Two stars meet once: their
centres link, or are further apart than both radii allow (Jaccard distance is a metric), or their members are compared:
the few next to the centre first, which connect most that can be connected, and all of them only where that didn't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import dropped, read_table, stage, text_blocks
from kgspark.llm.graph import components
from kgspark.llm.shingling import majority, mixed, shingles

SIZE, PERCENT = 5, 80
CELL_BITS, SLICES = 20, 64  # of the sketch: fixed, whatever the input
FOLDS = (1, 2, 4, 8, 16, 32, 64)
ROW_COST, VERIFY_COST = 1.0, 0.1  # of a row of a list, and of a shingle of a partner: about one in ten has a size that fits and is read
BLOCK = 1 << 20  # bytes of text whose arrays a task holds at once
FEW = 4  # members next to its centre that stand for a star at first
SLACK = 1e-9  # distances are compared a little too widely, links by whole numbers


def up(numerator: Column, denominator: int) -> Column:
    """Whole numbers' quotient, rounded up."""
    return F.floor((numerator + F.lit(denominator - 1)) / F.lit(denominator)).cast("long")


def overlap(na: Column, nb: Column, percent: int) -> Column:
    """Fewest common shingles of sets of ``na`` and ``nb`` that link."""
    return up((na + nb) * percent, 100 + percent)


def node_of(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for each set of hashes; 0 for empty ones."""
    out, some = np.zeros(len(start) - 1, np.uint64), np.flatnonzero(np.diff(start))
    if len(some):
        out[some] = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), start[some])
    return mixed(out)


def _scan(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(block, hashes, starts, nodes) of blocks of (doc_id, text)."""
    for batch in batches:
        for b in text_blocks(batch, "text", BLOCK):
            h, start = shingles([x.as_py() or b"" for x in b.column(1)], size)
            yield b, h, start, node_of(h, start)


def _new(nodes: np.ndarray, n: np.ndarray, seen: set) -> list[int]:
    """Places of the sets with shingles that this task hasn't met; ``seen`` has a number a row of the task at most."""
    out = []
    for i in np.flatnonzero(n).tolist():
        if (x := int(nodes[i])) not in seen:
            seen.add(x)
            out.append(i)
    return out


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def counted(docs: DataFrame, size: int, extra: str | None = None) -> DataFrame:
    """(doc_id, n, node) of every row, and rows with (slice, cells): each task's counts of shingles in the sketch's cells.

    With ``extra``, a column of long numbers, rows also have it and the set's SimHash: (..., extra, fp).
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n", "node", "slice", "cells", *(["extra", "fp"] if extra else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, ids = np.zeros(1 << CELL_BITS, np.uint32), set(), None
        for b, h, start, node in _scan(batches, size):
            n, ids = np.diff(start), b.column(0).type
            for i in _new(node, n, seen):
                np.add.at(cells, (h[start[i] : start[i + 1]] >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(n))
            more = [b.column(2), pa.array(majority(h, start).view(np.int64))] if extra else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node.view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary()), *more], names)
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(cells, SLICES)]
            none = pa.nulls(SLICES)
            more = [none.cast(pa.int64())] * 2 if extra else []
            yield pa.RecordBatch.from_arrays([none.cast(ids), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), *more], names)

    fields = f"doc_id {kind}, n long, node long, slice int, cells binary" + (", extra long, fp long" if extra else "")
    return _texts(docs, *([extra] if extra else [])).mapInArrow(scan, fields)


def sketch(rows: DataFrame) -> np.ndarray:
    """Counts of the whole corpus by cell: ``SLICES`` rows, 4 MB in all, reach the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(zlib.decompress(x), np.uint32)
                sums[k] = sums[k] + cells if k in sums else cells.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "cells"])

    got = rows.where("slice is not null").select("slice", "cells").repartition(SLICES, "slice").mapInArrow(total, "slice int, cells binary").collect()
    out = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.uint64)
    for r in got:
        out[r["slice"]] = np.frombuffer(r["cells"], np.uint64)
    return out.ravel()


def tiers(cells: np.ndarray) -> np.ndarray:
    """A cell's place in the order: 0 where it holds no more than chance puts there, else its size in octaves."""
    mean = max(1e-9, float(cells.mean()))
    return np.where(cells > mean + 6 * np.sqrt(mean) + 8, np.floor(np.log2(cells / mean + 1)) + 1, 0).astype(np.uint8)


def fold_of(weight: np.ndarray, n: int, least: int) -> int:
    """How many common shingles a document's prefix asks for, at least estimated cost.

    ``weight``: about how many documents have each of its shingles, in order. Rows of the lists are their sum; partners
    with m shingles in common are at most the others' rows / m.
    """
    rows = np.cumsum(weight)
    best, chosen = np.inf, 1
    for m in FOLDS:
        if m > least:
            break
        length = n - least + m
        cost = ROW_COST * rows[length - 1] + VERIFY_COST * n * (rows[length - 1] - length) / m
        if cost < best:
            best, chosen = cost, m
    return chosen


def prefixes(docs: DataFrame, cells: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, node, n, rest): the prefix of each set, once a task."""
    place, mean = tiers(cells), float(cells.mean())
    weights = np.maximum(1.0, cells - mean).astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, start, node in _scan(batches, size):
            n, out, own, rest = np.diff(start), [], [], []
            for i in _new(node, n, seen):
                x, many = h[start[i] : start[i + 1]], int(n[i])
                cell = (x >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                order = np.lexsort((mixed(x * np.uint64(0x9E3779B97F4A7C15)), place[cell]))
                least = -(-percent * many // 100)
                fold = fold_of(weights[cell[order]], many, least)
                out.append(x[order[: many - least + fold]])
                own.append(i)
                rest.append(least - fold)
            if own:
                lengths = [len(x) for x in out]
                spread = lambda x, kind: pa.array(np.repeat(x, lengths), kind)  # noqa: B023, E731
                columns = [pa.array(np.concatenate(out).view(np.int64)), spread(node[own].view(np.int64), pa.int64()), spread(n[own], pa.int32()), spread(rest, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "rest"])

    return _texts(docs).mapInArrow(scan, "token long, node long, n int, rest int")


def sets_of(docs: DataFrame, owners: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, s): the shingles of the sets in ``wanted`` (node), each read from the row that ``owners`` (node, doc_id) names.

    The ids' hashes go to the tasks as bits, at most 16 MB: some rows too many pass, and more where the ids are very many,
    but none is missed; so no text is shuffled.
    """
    kind = F.xxhash64(F.lit(53), "doc_id")
    about = wanted.agg(F.approx_count_distinct("node")).first()[0]  # only sizes the bits
    bits = min(27, max(10, (16 * max(1, about)).bit_length()))
    ids = owners.join(wanted.select("node").distinct(), "node", "left_semi").select(kind.alias("k"))
    slots = ids.select((F.shiftrightunsigned("k", 64 - bits)).alias("at"))
    words = slots.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    got = words.select("w", "b").toArrow()
    table = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    table[np.asarray(got["w"])] = np.asarray(got["b"]).view(np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def marked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.asarray(b.column(2)).view(np.uint64) >> np.uint64(64 - bits)
                yield b.select(["doc_id", "text"]).filter(pa.array((table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

        for _, h, start, node in _scan(marked(), size):
            own = _new(node, np.diff(start), seen)
            if own:
                parts = [h[start[i] : start[i + 1]] for i in own]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[own].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))], ["node", "s"])

    rows = _texts(docs).withColumn("k", kind)
    return stage(rows.mapInArrow(scan, "node long, s array<long>"), "join-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``union`` and ``common``: exact sizes, from whole sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.withColumn("union", F.size("sa") + F.size("sb") - F.col("common")).drop("sa", "sb").dropDuplicates(["a", "b"])


def near(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("union") * percent


def distance() -> Column:
    return 1 - F.col("common") / F.col("union")


def sizes_fit(percent: int, least_a: str, most_a: str, least_b: str, most_b: str) -> Column:
    """Whether sets of such sizes can link at all."""
    return (F.col(most_a) * 100 >= F.col(least_b) * percent) & (F.col(most_b) * 100 >= F.col(least_a) * percent)


def needed(percent: int, na: str, nb: str, rest_a: str, rest_b: str) -> Column:
    """Shingles that two prefixes must share."""
    return F.greatest(F.lit(1).cast("long"), overlap(F.col(na), F.col(nb), percent) - F.greatest(rest_a, rest_b))


def chosen(open_: DataFrame, shared: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each node with the leader that most of its lists have, where sizes and shared shingles let them link.

    A list's leader is its first node in an order that each turn draws anew, so that lists of one group agree on it and
    what one leader doesn't reach the next may. Lists have their nodes' sizes, so a pair's are known where it is made; a
    node makes a row a shingle of its prefix at most, and both sums over these are made where they meet.
    """
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "rest")).alias("l")
    lists = shared.groupBy("token").agg(first).select("token", F.col("l.node").alias("b"), F.col("l.n").alias("n_b"), F.col("l.rest").alias("rest_b"))
    pairs = open_.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a")).join(lists, "token").where("a <> b").drop("token")
    pairs = pairs.where(sizes_fit(percent, "n_a", "n_a", "n_b", "n_b")).repartition("a")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n_a", "rest_a", "n_b", "rest_b")])
    pairs = pairs.where(F.col("c") >= needed(percent, "n_a", "n_b", "rest_a", "rest_b"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))


def stars(docs: DataFrame, owners: DataFrame, shared: DataFrame, nodes: DataFrame, size: int, percent: int, rounds: int, hints: DataFrame | None) -> DataFrame:
    """(node, leader, r): nodes that link with a leader, at distance r; one leader a node.

    ``hints`` (a, b) are leaders b of nodes a that are tried first. Only saves work: whatever has no star is compared below.
    """
    out, open_ = None, shared
    for turn in range(0 if hints is None else -1, rounds):
        best = stage(chosen(open_, shared, turn, percent) if turn >= 0 else hints.join(nodes.select(F.col("node").alias("a")), "a", "left_semi"), "join-leaders")
        if best.isEmpty():
            continue
        sets = sets_of(docs, owners, best.select(F.explode(F.array("a", "b")).alias("node")), size)
        new = stage(verified(best, sets).where(near(percent)).select(F.col("a").alias("node"), F.col("b").alias("leader"), distance().alias("r")), "join-stars")
        dropped(best, sets)
        if out is not None:
            old, new = (out, new), stage(out.unionByName(new), "join-stars")
            dropped(*old)
        out = new
        gone = out.select(F.explode(F.array("node", "leader")).alias("node")).distinct()
        open_ = shared.join(gone, "node", "left_anti")  # of all turns so far
    return out if out is not None else nodes.limit(0).select("node", F.col("node").alias("leader"), F.lit(0.0).alias("r"))


def links(docs: DataFrame, owners: DataFrame, size: int, percent: int, cells: np.ndarray, rounds: int = 3, hints: DataFrame | None = None) -> DataFrame:
    """(a, b): links of different sets, enough to connect all that are connected."""
    postings = prefixes(docs, cells, size, percent)
    own = Window.partitionBy("token")
    shared = postings.withColumns({"_low": F.min("node").over(own), "_high": F.max("node").over(own)}).where("_low <> _high")
    shared = stage(shared.select("token", "node", "n", "rest"), "join-lists")
    nodes = stage(shared.groupBy("node").agg(F.first("n").alias("n"), F.first("rest").alias("rest")), "join-nodes")
    star = stars(docs, owners, shared, nodes, size, percent, rounds, hints)
    found = star.select(F.col("node").alias("a"), F.col("leader").alias("b"))

    # a node that leads a star is the centre of it, whatever star it is in itself
    leads = star.select(F.col("leader").alias("node")).distinct()
    member = star.join(leads, "node", "left_anti").select("node", F.col("leader").alias("centre"), "r")
    placed = nodes.join(member, "node", "left").select("node", "n", "rest", F.coalesce("centre", "node").alias("centre"), F.coalesce("r", F.lit(0.0)).alias("r"))
    placed = stage(placed, "join-placed")
    centres = placed.groupBy("centre").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.max("r").alias("r"))
    centres = stage(centres, "join-centres")
    rows = stage(shared.select("token", "node").join(placed.select("node", "centre"), "node").groupBy("token", "centre").agg(F.count("*").alias("_")).drop("_"), "join-rows")
    dropped(shared)

    met = rows.select("token", F.col("centre").alias("a")).join(rows.select("token", F.col("centre").alias("b")), "token").where("a < b")
    met = met.groupBy("a", "b").agg(F.count("*").alias("c"))
    for c in "ab":
        met = met.join(centres.select(F.col("centre").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("least", "most", "rest", "r")]), c)
    met = met.where(sizes_fit(percent, "least_a", "most_a", "least_b", "most_b"))
    met = met.where(F.col("c") >= needed(percent, "least_a", "least_b", "rest_a", "rest_b"))
    met = stage(met.select("a", "b", "r_a", "r_b"), "join-met")
    dropped(rows, centres)
    if met.isEmpty():
        return found
    ends = met.select(F.explode(F.array("a", "b")).alias("node"))
    sets = sets_of(docs, owners, ends, size)
    tried = stage(verified(met, sets).withColumn("d", distance()), "join-tried")
    dropped(met, sets)
    found = found.unionByName(tried.where(near(percent)).select("a", "b"))

    # stars whose centres don't link, though members may; where two components have several, the nearest goes first
    wide = 1 - percent / 100 + SLACK
    open_ = tried.where(~near(percent)).where(F.col("d") <= wide + F.col("r_a") + F.col("r_b")).where("r_a > 0 or r_b > 0")
    open_ = stage(open_.select("a", "b", "r_a", "r_b", "d"), "join-open")
    if open_.isEmpty():
        return found
    members = placed.where("r > 0").select("centre", F.col("node").alias("x"), "r")
    few = members.withColumn("_k", F.row_number().over(Window.partitionBy("centre").orderBy("r", "x"))).where(F.col("_k") <= FEW).drop("_k")
    few = stage(few, "join-few")
    open_ = stage(apart(open_, found), "join-left")
    if open_.isEmpty():
        return found
    stars_left = open_.select(F.explode(F.array("a", "b")).alias("centre")).distinct()
    ends = stars_left.select(F.col("centre").alias("node")).unionByName(members.join(stars_left, "centre", "left_semi").select(F.col("x").alias("node")))
    sets = sets_of(docs, owners, ends, size)
    for some, nearest in ((few, True), (members, True), (members, False)):
        left = open_
        if nearest:
            first = left.groupBy("low", "high").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")
            left = stage(left.join(first, ["a", "b"], "left_semi"), "join-left")
        new = stage(member_links(left, some, sets, percent, wide), "join-member-links")
        found = found.unionByName(new.select("a", "b"))
        if some is members:  # all of these pairs is known now
            open_ = open_.join(left.select("a", "b"), ["a", "b"], "left_anti")
        open_ = stage(merged(open_, new), "join-left")
        if open_.isEmpty():
            break
    dropped(sets)
    return found


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) that ``found`` doesn't connect, with the components of their ends (low, high)."""
    root = stage(components(found), "join-roots")
    for c in "ab":
        pairs = pairs.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.withColumns({"low": F.least("root_a", "root_b"), "high": F.greatest("root_a", "root_b")}).where("low <> high").drop("root_a", "root_b")


def merged(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """``pairs`` (low, high, ...) that are still apart when ``new`` has connected its components (low, high)."""
    root = stage(components(new.select(F.col("low").alias("a"), F.col("high").alias("b"))), "join-roots")
    for c in ("low", "high"):
        pairs = pairs.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    pairs = pairs.withColumns({"low": F.least("root_low", "root_high"), "high": F.greatest("root_low", "root_high")})
    return pairs.where("low <> high").drop("root_low", "root_high")


def halves(pairs: DataFrame, members: DataFrame, wide: float) -> DataFrame:
    """(a, b): members and the other star's centre, where distances let them or any member of the other star link.

    A member has one star, so it meets a centre once. ``pair``: the two centres; ``of``: whose member a is.
    """
    rows = []
    for c, o in ("ab", "ba"):
        both = pairs.join(members.withColumnRenamed("centre", c), c).where(F.col("d") - F.col("r") <= wide + F.col(f"r_{o}"))
        rows.append(both.select(F.col("x").alias("a"), F.col(o).alias("b"), "r", F.col(f"r_{o}").alias("r_other"), F.lit(c).alias("of"), F.struct("a", "b").alias("pair"), "low", "high"))
    return rows[0].unionByName(rows[1])


def member_links(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int, wide: float) -> DataFrame:
    """Links (a, b) between the stars of ``pairs``, with the components (low, high) that they connect.

    Each member against the other centre, then what distances allow of both stars.
    """
    seen = stage(verified(stage(halves(pairs, members, wide), "join-halves"), sets).withColumn("d", distance()), "join-half-tried")
    left = seen.where(~near(percent)).where(F.col("d") <= wide + F.col("r_other"))
    one = left.where("of = 'a'").select("pair", "low", "high", F.col("a").alias("xa"), F.col("r").alias("ra"), F.col("d").alias("da"))
    two = left.where("of = 'b'").select("pair", F.col("a").alias("xb"), F.col("r").alias("rb"), F.col("d").alias("db"))
    last = one.join(two, "pair").where((F.col("da") - F.col("rb") <= wide) & (F.col("db") - F.col("ra") <= wide))
    last = verified(last.select(F.col("xa").alias("a"), F.col("xb").alias("b"), "low", "high"), sets)
    return seen.where(near(percent)).select("a", "b", "low", "high").unionByName(last.where(near(percent)).select("a", "b", "low", "high"))


def similar_documents(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents connected by pairs with 100 * common >= ``percent`` * union shingles.

    Words are runs of other than white space, A-Z lower-cased; a text of fewer than ``size`` words is one shingle. Null
    and wordless texts have none, link with nothing and are their own component. Null ids take part, but a component's
    id is its smallest one that isn't null (null if there is none). Repeated rows each give a row; equal sets link. A
    pair at exactly ``percent`` links. Texts of any length count whole. Shingles are known by 64-bit hashes. An empty
    table gives no rows; other columns don't matter.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    signed = stage(counted(docs, size), "join-signed")
    cells = sketch(signed)
    signed = signed.where("slice is null").select("doc_id", "n", "node")
    owners = stage(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "join-owners")
    roots = components(stage(links(docs, owners, size, percent, cells), "join-links"))
    named = stage(owners.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "join-named")
    least = stage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-least")
    named = named.join(least, "root").select(F.col("node").alias("_node"), "component_id")
    rows = signed.join(named, (signed["node"] == named["_node"]) & (signed["n"] > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))
