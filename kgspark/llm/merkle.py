"""Merkle manifest of a dataset: a content-addressed store of digests, and proofs by descent from the root.

Leaves are digests of rows, numbered within their source by id. A tree has three children a node; subroots of sources
are the leaves of the top tree. Every inner node is one record, digest -> children, under its height; equal nodes are
one record. Requests for leaves start at the root as one row and descend by the digits of their ranks (base 3): a row
stands for all requests below its node, meets the record of its digest, and goes on as one row a child, with the
children not taken. The last step is each leaf's own. The path's segments, reversed, are the proof.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import read_table, stage

ARITY = 3
LEVELS = 4  # of a tree that are built in one shuffle: groups of at most ARITY ** LEVELS digests
CUT = 6  # steps of the descent between two tables
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    return digest(*[field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS])


def depth_of(n: str) -> Column:
    """Levels above n leaves: the least d with ARITY ** d >= n."""
    powers = [ARITY**k for k in range(math.ceil(63 / math.log2(ARITY)))]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < F.col(n)))


def numbered(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """Add ``name``, each row's place from 0 on in the order of ``keys``: ranges are numbered apart, after those before them.

    The driver gets a count a range, one for each shuffle partition.
    """
    parts = stage(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "merkle-ranges")
    offsets, at = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(part), F.lit(at).cast("long")]
        at += n
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return parts.withColumn(name, (offset + place).cast("long")).drop("_part")


def above(level: Column) -> Column:
    """The digests of the next level: one of every ``ARITY`` digests in a row."""
    return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(level, i * ARITY + 1, F.lit(ARITY))), 256))


def grown(leaves: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """(roots (tree, root), records (height, digest, children)) of trees over leaves (tree, pos, digest, depth).

    ``deepest``: the largest depth. A group is a subtree of at most ARITY ** LEVELS leaves, whatever a tree's size.
    """
    roots = leaves.where("depth = 0").select("tree", F.col("digest").alias("root"))
    records: list[DataFrame] = []
    rows = leaves.where("depth > 0")
    for base in range(0, deepest, LEVELS):
        group = rows.groupBy("tree", F.floor(F.col("pos") / ARITY**LEVELS).cast("long").alias("pos"), "depth")
        built = group.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("_l")).withColumn("l0", F.col("_l.digest")).drop("_l")
        for k in range(1, LEVELS + 1):
            # levels above a tree's root stay empty
            built = built.withColumn(f"l{k}", F.when(F.col("depth") >= base + k, above(F.col(f"l{k - 1}"))))
        built = stage(built, "merkle-levels")
        for k in range(1, LEVELS + 1):
            node = F.posexplode(f"l{k}").alias("i", "digest")
            made = built.where(F.col("depth") >= base + k).select(node, f"l{k - 1}")
            records.append(made.select(F.lit(base + k).alias("height"), "digest", F.slice(f"l{k - 1}", F.col("i") * ARITY + 1, F.lit(ARITY)).alias("children")))
            top = built.where(F.col("depth") == base + k).select("tree", F.element_at(f"l{k}", 1).alias("root"))
            roots = roots.unionByName(top)
        rows = built.where(F.col("depth") > base + LEVELS).select("tree", "pos", F.element_at(f"l{LEVELS}", 1).alias("digest"), "depth")
    store = None
    for r in records:
        store = r if store is None else store.unionByName(r)
    if store is None:
        store = leaves.select(F.lit(1).alias("height"), "digest", F.array("digest").alias("children")).limit(0)
    return stage(roots, "merkle-roots"), store


def stored(records: DataFrame, name: str) -> DataFrame:
    """The store: one record for each digest, in a folder for each height."""
    return stage(records.groupBy("height", "digest").agg(F.first("children").alias("children")), name)


def taken(children: str, i: Column) -> Column:
    """The children not taken: digests left and right of the i-th, joined."""
    side = lambda low: F.concat_ws("", low)
    return F.struct(side(F.slice(children, F.lit(1), i)).alias("l"), side(F.slice(children, i + 2, F.lit(ARITY))).alias("r"))


def step(at: DataFrame, store: DataFrame, height: int) -> DataFrame:
    """Requests (tree, pos, digest, path) one level down: a row a child, with the children not taken at the path's end."""
    met = at.join(store.where(F.col("height") == height).select("digest", "children"), "digest")
    met = met.select("tree", "pos", "path", "children", F.posexplode("children").alias("i", "digest"))
    return met.select("tree", (F.col("pos") * ARITY + F.col("i")).alias("pos"), "digest", F.array_append("path", taken("children", F.col("i"))).alias("path"))


def descend(starts: DataFrame, store: DataFrame, deepest: int, upto: int) -> DataFrame:
    """(tree, pos, digest, path) of all nodes at height ``upto``; ``starts`` (tree, digest, path, depth): the trees' roots."""
    begin = lambda h: starts.where(F.col("depth") == h).select("tree", F.lit(0).cast("long").alias("pos"), "digest", "path")
    at = begin(deepest)
    for height in range(deepest, upto, -1):
        at = step(at, store, height).unionByName(begin(height - 1))
        if (deepest - height) % CUT == CUT - 1:
            at = stage(at, "merkle-requests")
    return at


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; see the module for the tree.

    A leaf: sha256 of doc_id, source, lang, n_chars and text, each with its byte count, ``-`` where null. A source's leaves
    stand by doc_id, nulls first; rows under one id by their digests, and equal rows are interchangeable. Sources stand
    by their bytes, null first. Where crc32 of the id is even the text's line feeds are taken out before the proof is folded
    again (a null id or text is left as it is). Empty texts are ordinary values; texts of any length are hashed whole,
    where they lie. One row alone is its own root, with an empty proof. An empty table gives no rows; other columns
    are ignored.
    """
    id_ = F.col("doc_id").cast("string")
    tampered = F.when(F.crc32(id_) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(F.crc32(id_) % 2 == 0, leaf_digest(tampered)).alias("other"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_row")]
    rows = stage(numbered(rows, order, "place"), "merkle-places")
    sources = rows.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = numbered(sources, [F.col("source").asc_nulls_first()], "tree").withColumn("depth", depth_of("n"))
    sources = stage(sources.select(F.col("source").alias("_source"), "first", "tree", "depth"), "merkle-sources")
    leaves = rows.join(sources, rows["source"].eqNullSafe(sources["_source"])).withColumn("pos", F.col("place") - F.col("first"))
    leaves = stage(leaves.select("doc_id", "tree", "pos", "depth", F.col("leaf").alias("digest"), "other"), "merkle-trees")

    deepest, many = sources.agg(F.max("depth"), F.count("*")).first()
    if not many:
        deepest = 0
    roots, records = grown(leaves.select("tree", "pos", "digest", "depth"), deepest)
    top_depth = next(d for d in range(64) if ARITY**d >= many)
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.lit(top_depth).alias("depth"))
    top_roots, top_records = grown(top, top_depth)
    store, top_store = stored(records, "merkle-store"), stored(top_records, "merkle-top")

    no_path = F.array().cast("array<struct<l:string,r:string>>")
    begin = top_roots.select("tree", F.col("root").alias("digest"), no_path.alias("path"), F.lit(top_depth).alias("depth"))
    subroots = descend(begin, top_store, top_depth, 0).select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "path")
    subroots = stage(subroots.join(sources.select("tree", "depth"), "tree"), "merkle-subroots")
    starts = subroots.select("tree", F.col("subroot").alias("digest"), "path", "depth")
    # the last level's segments are each leaf's own, so that paths move once for ARITY leaves
    last = descend(starts.where("depth > 0"), store, deepest, 1)
    last = last.join(store.where("height = 1").select("digest", "children"), "digest").select("tree", F.col("pos").alias("_up"), "path", "children")
    low = leaves.where("depth > 0").withColumn("_up", F.floor(F.col("pos") / ARITY).cast("long")).join(last, ["tree", "_up"])
    low = low.withColumn("path", F.array_append("path", taken("children", (F.col("pos") % ARITY).cast("int"))))
    names = ["doc_id", "tree", "digest", "other", "path"]
    alone = leaves.where("depth = 0").join(subroots.select("tree", "path"), "tree").select(*names)
    found = low.select(*names).unionByName(alone).withColumn("path", F.reverse("path"))
    fold = lambda leaf: F.aggregate("path", leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"]))), 256)
    root = top_roots.select(F.col("root"))
    found = found.join(subroots.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))  # one row
    found = found.withColumn("folded_root", fold(F.coalesce("other", "digest")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


_F = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_HEAD = " || ".join(_F.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LEAF = lambda t: f"sha256({_HEAD} || {_F.format(t)})"
#: crc32 of the id before its last inversion, a bit at a time.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"
#: Levels by recursion, siblings by joins on the level.
SQL = f"""WITH RECURSIVE docs AS (SELECT *, xor({_CRC}, 1) & 1 = 0 AS hit, replace(text, chr(10), '') AS cut FROM documents),
leaves AS (SELECT doc_id, source, {_LEAF('text')} AS leaf, CASE WHEN hit THEN {_LEAF('cut')} ELSE {_LEAF('text')} END AS other FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM leaves),
up AS (SELECT p, 0 AS h, i, leaf AS d, n FROM placed
  UNION ALL SELECT p, h + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY p, h, i // 3),
subroots AS (SELECT p, h, d FROM up WHERE n = 1),
top AS (SELECT 0 AS h, p AS i, d, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT h + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY h, i // 3),
nodes AS (SELECT p, h, i, d FROM up WHERE n > 1 UNION ALL SELECT s.p, s.h + t.h, t.i, t.d FROM subroots s, top t WHERE t.n > 1),
spot AS (SELECT doc_id, x.p, nodes_h.h, CASE WHEN nodes_h.h < s.h THEN x.i // CAST(power(3, nodes_h.h) AS BIGINT) ELSE x.p // CAST(power(3, nodes_h.h - s.h) AS BIGINT) END AS i
  FROM placed x JOIN subroots s ON s.p = x.p JOIN (SELECT DISTINCT p, h FROM nodes) nodes_h ON nodes_h.p = x.p),
sides AS (SELECT spot.doc_id, spot.p, spot.h, coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (WHERE n.i < spot.i), '') AS l, coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (WHERE n.i > spot.i), '') AS r
  FROM spot JOIN nodes n ON n.p = spot.p AND n.h = spot.h AND n.i // 3 = spot.i // 3 GROUP BY ALL),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY h) AS proof FROM sides GROUP BY 1),
fold AS (SELECT doc_id, 0 AS h, other AS d FROM placed UNION ALL SELECT f.doc_id, f.h + 1, sha256(s.l || f.d || s.r) FROM fold f JOIN sides s ON s.doc_id = f.doc_id AND s.h = f.h),
folded AS (SELECT doc_id, arg_max(d, h) AS d FROM fold GROUP BY 1), root AS (SELECT d FROM top WHERE n = 1)
SELECT x.doc_id, x.leaf, s.d AS subroot, root.d AS root, sha256(coalesce(pr.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM placed x JOIN subroots s ON s.p = x.p CROSS JOIN root JOIN folded f ON f.doc_id = x.doc_id LEFT JOIN proofs pr ON pr.doc_id = x.doc_id"""
