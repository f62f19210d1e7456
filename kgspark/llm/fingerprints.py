"""Document fingerprints: SimHash with weighted terms, and permuted block tables that find all within a Hamming radius.

Terms are pairs of adjacent words; longer pairs weigh more. Each term's hash votes with its weight for or against
each of 64 bits. For a search, the 64 bits are cut into blocks; fingerprints within the radius agree on all but that
many blocks, so one table for each choice of the others, keyed by them, finds every one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.bits import differing, hex16, majority, vote_sums
from kgspark.llm.common import read_table, stage

SPACE = r"[\x20\x09-\x0D]+"
RADIUS = 3
BLOCKS = 6


def terms(rows: DataFrame, text: str) -> DataFrame:
    """A row for each term of ``text`` (one with nulls if there is none): all other columns, h (hash) and w (weight).

    Words are paired as two columns of one exploded array, so that hashing and weighing run in compiled code. A text of
    one word has that word alone.
    """
    others = [c for c in rows.columns if c != text]
    rows = rows.select(*others, F.array_remove(F.split(text, SPACE), "").alias("_w"))
    pairs = F.arrays_zip(F.expr("slice(_w, 1, greatest(size(_w) - 1, 1))").alias("a"), F.expr("slice(_w, 2, size(_w))").alias("b"))
    rows = rows.select(*others, F.explode_outer(pairs).alias("p")).select(*others, "p.a", "p.b")
    length = F.length("a") + F.coalesce(F.length("b"), F.lit(0))
    return rows.select(*others, F.when(F.col("a").isNotNull(), F.xxhash64("a", "b")).alias("h"), F.when(F.col("a").isNotNull(), weight(length)).alias("w"))


def weight(chars: Column) -> Column:
    """1 to 4 by the term's characters: common short words say little."""
    return F.when(chars < 8, 1).when(chars < 12, 2).when(chars < 16, 3).otherwise(4).cast("long")


def place(docs: DataFrame, rows_per_bucket: int, most_buckets: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(docs with ``bucket`` and ``key``, the table of buckets): buckets follow the order (doc_id, text hash), null ids first.

    About ``ranges`` cuts come from a bounded sample of ids, chosen by hash. An id with more rows than such a range
    should have (there are at most ``ranges`` of those) is a range of its own. A range is divided evenly by id, such an
    id by text hash, into as many buckets as its rows need. Only ids are read, and what the driver holds is a few
    numbers a range. The table: bucket, first (least id or, for such an id, hash), before (the bucket in front; the last
    one for the first); it has at most about ``most_buckets`` rows, which bounds its broadcast.
    """
    ids = docs.select("doc_id")
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    most = max(rows_per_bucket, n // ranges, 1)
    hot = [r["doc_id"] for r in ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()] if n > most else []
    picked = ids.where(F.pmod(F.xxhash64(F.lit(19), "doc_id"), F.lit(1 << 30)) < min(1.0, 8 * ranges / max(1, n)) * (1 << 30))
    sample = sorted(r["doc_id"] for r in picked.where("doc_id is not null").distinct().collect()) if n > rows_per_bucket else []
    own = {x for x in hot if x is not None}
    cuts = sorted(set(sample[:: max(1, -(-len(sample) // ranges))][1:]) | own | {x + 1 for x in own if x < (1 << 63) - 1})
    side = max(1, int(len(cuts) ** 0.5))
    among = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    outer = cuts[side - 1 :: side]
    top = below(among(outer))
    inner = F.array(*[among(cuts[i * side : i * side + side - 1]) for i in range(len(outer) + 1)])
    # range 0 has the null ids
    range_ = F.when(F.col("doc_id").isNull(), 0).otherwise(top * side + below(F.element_at(inner, top + 1)) + 1)
    counts = {r["r"]: r["n"] for r in ids.select(range_.alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = docs.withColumn("_r", range_.cast("int"))
    edges = [low or 0, *cuts, (high or 0) + 1]
    per = max(rows_per_bucket, -(-n // most_buckets))
    size, offset, first, width, hashed = [], [], [], [], []
    for r in range(len(cuts) + 2):
        lo, hi = (0, 1) if r == 0 else (edges[r - 1], edges[r])
        offset.append(offset[-1] + size[-1] if size else 0)
        size.append(max(1, -(-counts.get(r, 0) // per)))
        first.append(lo)
        width.append(max(1.0, float(hi - lo)))
        hashed.append(r == 0 or lo in own)
    of = lambda xs, kind: F.element_at(F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>"), F.col("_r") + 1)
    by_id = (F.col("doc_id") - of(first, "double")) / of(width, "double")
    by_hash = (F.shiftright(F.xxhash64("text"), 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    share = F.when(of(hashed, "boolean"), by_hash).otherwise(F.coalesce(by_id, F.lit(0.0))) if any(hashed[1:]) or counts.get(0, 0) > per else F.coalesce(by_id, F.lit(0.0))
    parts = of(size, "long")
    bucket = of(offset, "long") + F.least(F.greatest(F.floor(share * parts), F.lit(0)), parts - 1)
    key = F.when(of(hashed, "boolean"), F.xxhash64("text") if any(hashed[1:]) or counts.get(0, 0) > per else F.lit(0).cast("long")).otherwise(F.col("doc_id"))
    placed = docs.withColumns({"bucket": bucket, "key": key}).drop("_r")
    firsts = placed.groupBy("bucket").agg(F.min("key").alias("first"))
    firsts = firsts.withColumn("before", F.lag("bucket").over(Window.orderBy("bucket")))
    firsts = firsts.withColumn("before", F.coalesce("before", F.max("bucket").over(Window.partitionBy(F.lit(1)))))
    return placed, firsts


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, most_buckets: int = 1 << 20, ranges: int = 1024) -> DataFrame:
    """Rows of (bucket, rank, doc_id, text, next_text, ghost): each text with that of the next document by (doc_id, text hash).

    Texts move once, to buckets that follow that order. Each bucket also gets the rows that open the next one as
    ``ghost``, so that no row needs a neighbour elsewhere. The last document's next is the first.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, firsts = place(docs, rows_per_bucket, most_buckets, ranges)
    firsts = stage(firsts, "fingerprint-buckets")
    rows = rows.join(F.broadcast(firsts.withColumnRenamed("bucket", "_b")), (F.col("bucket") == F.col("_b")) & (F.col("key") == F.col("first")), "left")
    copies = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(False).alias("ghost"))))
    copies = copies.otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))))
    rows = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.bucket", "c.ghost")
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.select("bucket", F.row_number().over(line).alias("rank"), "doc_id", "ghost", "text", F.lead("text").over(line).alias("next_text"))


def edited_text() -> Column:
    """The text with its last quarter replaced by as many first characters of the next one."""
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for each document (fingerprints as longs).

    Null texts are empty; empty texts have fingerprint zero. Repeated ids are ordered by their texts' hashes; equal rows
    are interchangeable. Null ids come first. A table of one row is its own next; an empty one gives no rows. Texts of
    any length are read whole; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited_text()))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    # a hash aggregate holds numbers only: the digest travels as four
    digest = [f"sha{k}" for k in range(4)]
    word = lambda k, i: F.conv(F.substring("edited_sha256", 16 * k + 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.withColumns({c: F.shiftleft(word(k, 0), 32).bitwiseOR(word(k, 1)) for k, c in enumerate(digest)})
    kinds = ["doc_id", "ghost", "n_chars", *digest]
    keys, own = ["bucket", "rank"], [F.min(c).alias(c) for c in kinds]
    both_texts = F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("x")), F.struct(F.lit(1).alias("e"), F.coalesce("edited", F.lit("")).alias("x")))
    each = rows.select(*keys, *kinds, F.explode(both_texts).alias("t")).select(*keys, *kinds, "t.e", "t.x")
    sums = terms(each, "x").groupBy(*keys, "e").agg(F.sum("w").alias("total"), *own, *vote_sums("h", F.col("w")))
    fps = sums.select(*keys, "e", *kinds, F.coalesce(majority("total"), F.lit(0).cast("long")).alias("one"))
    both = fps.groupBy(*keys).agg(
        *own, F.max(F.when(F.col("e") == 0, F.col("one"))).alias("fp"), F.max(F.when(F.col("e") == 1, F.col("one"))).alias("edited_fp")
    )
    zero = F.lit(0).cast("long")
    both = both.withColumn("fp", F.coalesce("fp", zero)).withColumn("edited_fp", F.coalesce("edited_fp", zero))
    out = both.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rank"))).where(~F.col("ghost"))
    return out.select("doc_id", "n_chars", F.concat(*[hex16(c) for c in digest]).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the tables: each choice of ``blocks - radius`` of the blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q, fp) for every distinct query fingerprint ``q`` and every distinct ``fp`` within ``radius`` bits of it.

    A table's key is the table's number and the masked fingerprint, so a bucket holds only what agrees on all of its
    blocks. A pair that several tables find is reported by the first that can: no deduplication is needed.
    """
    masks = block_masks(blocks, radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).cast("long").alias("m")) for i, m in enumerate(masks)])
    keyed = lambda df, c: df.select(c, F.explode(tables).alias("x")).select(c, "x.t", F.col(c).bitwiseAND(F.col("x.m")).alias("k"))
    pairs = keyed(queries.select(F.col("fp").alias("q")).distinct(), "q").join(keyed(fps.select("fp").distinct(), "fp"), ["t", "k"])
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return pairs.where((F.bit_count(apart) <= radius) & (F.col("t") == first)).select("q", "fp")


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - differing(a, b) / F.lit(64.0)


def counted(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add ``n_within`` to (doc_id, fp, ...) rows whose id is divisible by 100: rows within ``radius`` bits, itself included."""
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 100 = 0").select("doc_id", "fp").distinct()
    found = within_radius(asked, counts, radius).join(counts, "fp").groupBy("q").agg(F.sum("n").alias("n_within"))
    asked = asked.join(found, F.col("fp") == F.col("q")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "n_within")
    return rows.join(asked, (rows["doc_id"] == asked["_id"]) & (rows["fp"] == asked["_fp"]), "left").drop("_id", "_fp")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses; ``n_within`` for ids divisible by 100: documents within the radius, itself included."""
    out = counted(stage(fingerprint_documents(read_table(spark, sf_dir, "documents")), "fingerprint-rows"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_within",
    )
