"""Link resolution: a prioritised left join of links to notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.links import context, line_of, unresolved_key, wikilinks
from kgspark.functions.notes import with_path_parts
from kgspark.session import stage


def resolve(links: DataFrame, notes: DataFrame, target: str = "link_path") -> DataFrame:
    """Add ``dst`` (path of the note that a link means, null if none) to links of (vault, path, ...).

    First the exact path (``.md`` added where missing), else notes of the same name without regard to case: one in
    the source's folder first, then the least deep, then by path. The name table is reduced to its best note a name
    and a name and folder before the joins, so every join is one row to at most one and nothing multiplies.
    """
    files = with_path_parts(notes.select("vault", "path")).withColumn("_key", F.lower("name"))
    exact = files.select(F.col("vault").alias("_v"), F.col("path").alias("_exact"))
    best = Window.partitionBy("vault", "_key").orderBy("depth", F.collate("path", "UNICODE"), "path")
    by_name = files.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("vault").alias("_nv"), F.col("_key").alias("_nk"), F.col("path").alias("_by_name"))
    beside = files.groupBy("vault", "dir", "_key").agg(F.min("path").alias("_beside")).select(F.col("vault").alias("_bv"), F.col("dir").alias("_bd"), F.col("_key").alias("_bk"), "_beside")

    t = F.col(target)
    full = F.when(t.endswith(".md"), t).otherwise(F.concat(t, F.lit(".md")))
    key = F.lower(F.regexp_replace(F.element_at(F.split(full, "/"), -1), r"\.md$", ""))
    rows = links.withColumns({"_full": full, "_key": key, "_dir": F.regexp_replace("path", "/?[^/]*$", "")})
    rows = rows.join(exact, (F.col("vault") == F.col("_v")) & (F.col("_full") == F.col("_exact")), "left")
    rows = rows.join(beside, (F.col("vault") == F.col("_bv")) & (F.col("_dir") == F.col("_bd")) & (F.col("_key") == F.col("_bk")), "left")
    rows = rows.join(by_name, (F.col("vault") == F.col("_nv")) & (F.col("_key") == F.col("_nk")), "left")
    dst = F.when(t != "", F.coalesce("_exact", "_beside", "_by_name"))
    return rows.withColumn("dst", dst).drop("_full", "_key", "_dir", "_v", "_exact", "_bv", "_bd", "_bk", "_beside", "_nv", "_nk", "_by_name")


def resolved_links(notes: DataFrame, column: str = "raw", target: str = "link_path") -> DataFrame:
    return resolve(wikilinks(notes, column), notes, target)


def edges(links: DataFrame) -> DataFrame:
    """(vault, src, dst, cnt) of resolved links within a vault, embeds counted, self-links left out."""
    rows = links.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("path")) & F.col("link_vault").isNull())
    return rows.groupBy("vault", F.col("path").alias("src"), "dst").agg(F.count("*").alias("cnt"))


def link_stats(links: DataFrame) -> DataFrame:
    """(vault, resolved, unresolved, distinct_unresolved) occurrences; links to themselves and other vaults don't count."""
    rows = links.where(F.col("link_vault").isNull() & (F.col("link_path") != ""))
    missing = F.col("dst").isNull()
    return rows.groupBy("vault").agg(
        F.count(F.when(F.col("dst") != F.col("path"), 1)).alias("resolved"),
        F.count(F.when(missing, 1)).alias("unresolved"),
        F.count_distinct(F.when(missing, unresolved_key(F.col("target")))).alias("distinct_unresolved"),
    )


def unresolved_rollup(links: DataFrame) -> DataFrame:
    """(target, occurrences, sources) of missing targets; links to other vaults and to nothing but a subpath don't count."""
    rows = links.where(F.col("dst").isNull() & F.col("link_vault").isNull() & (F.col("link_path") != "")).withColumn("key", unresolved_key(F.col("target")))
    return rows.groupBy(F.col("key").alias("target")).agg(F.count("*").alias("occurrences"), F.count_distinct("path").alias("sources"))


def backlinks(notes: DataFrame, path: str) -> DataFrame:
    """(vault, path, links) of notes that point at ``path``, as of ``backlink_places``."""
    return backlink_hits(notes, path).groupBy("vault", "path").agg(F.count("*").alias("links"))


def backlink_places(notes: DataFrame, path: str) -> DataFrame:
    """(vault, path, links, line_no, context): backlinks with the first of each note, its line and the text around it."""
    first = backlink_hits(notes, path).groupBy("vault", "path").agg(F.count("*").alias("links"), F.min_by("match", "ord").alias("match"))
    rows = first.join(notes.select("vault", "path", "raw"), ["vault", "path"])
    return rows.select("vault", "path", "links", line_of(F.col("raw"), F.col("match")).alias("line_no"), context(F.col("raw"), F.col("match")).alias("context"))


def backlink_hits(notes: DataFrame, path: str) -> DataFrame:
    """Links of other notes that point at ``path`` by text: name or path, with or without .md, or as the last part.

    The compared target keeps its subpath, so a link to a heading doesn't count; case doesn't matter.
    """
    low = path.lower()
    bare = low.removesuffix(".md")
    name = bare.rsplit("/", 1)[-1]
    t = F.lower("target")
    hit = t.isin(low, bare, name, f"{name}.md") | t.endswith(f"/{name}")
    return wikilinks(notes, "raw").where(hit & (F.col("path") != path))


#: Longer names, in code points or in runs of letters and digits, are neither compared nor looked up.
MOST_CHARS, MOST_TOKENS = 128, 16


def comparable(name: Column) -> Column:
    runs = F.size(F.filter(F.split(F.trim(name), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    return (F.length(name) <= MOST_CHARS) & (runs <= MOST_TOKENS)


def closest(names: DataFrame, wanted: str, most: int = 3, reach: int = 3) -> DataFrame:
    """(name, distance) of up to ``most`` names that contain ``wanted``, lie in it, or are within ``reach`` edits."""
    low, word = F.lower("name"), F.lit(wanted.lower())
    rows = names.select("name").where(comparable(F.col("name")) & comparable(F.lit(wanted))).distinct()
    rows = rows.withColumn("distance", F.levenshtein(low, word))
    near = F.contains(low, word) | F.contains(word, low) | (F.col("distance") <= reach)
    return rows.where(near).orderBy("distance", "name").limit(most)


#: Stands for a changed letter; no text has it.
CHANGED = "\uffff"


def variants(rows: DataFrame, text: str, reach: int) -> DataFrame:
    """Rows with ``key``, ``subs`` and ``gone``: ``text`` with up to ``reach`` letters marked as changed or left out.

    The array ``most`` of a row says how many may be changed, by the number left out (-1: none of those is wanted).
    Letters are picked from left to right, one a step, as rows: no row holds all variants of a text.
    """
    own = rows.columns
    rows = rows.withColumns({"key": F.col(text), "subs": F.lit(0), "gone": F.lit(0), "_at": F.lit(1)})
    for _ in range(reach):
        n, op = F.length("key"), F.col("_op")
        more = F.when(F.col("_at") <= n, F.sequence(2 * F.col("_at"), 2 * n + 1)).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn("_op", F.explode(F.concat(F.array(F.lit(0)), more)))  # 0: no more; else the place, and whether it goes
        place, goes = F.floor(op / 2).cast("int"), op % 2 == 1
        cut = F.concat(F.substring("key", F.lit(1), place - 1), F.when(goes, "").otherwise(CHANGED), F.substring("key", place + 1, n))
        rows = rows.select(
            *own, F.when(op == 0, F.col("key")).otherwise(cut).alias("key"), (F.col("subs") + ((op > 0) & ~goes).cast("int")).alias("subs"), (F.col("gone") + goes.cast("int")).alias("gone"),
            F.when(op == 0, n + 1).when(goes, place).otherwise(place + 1).alias("_at"),
        ).where(F.col("subs") <= F.array_max(F.slice("most", F.col("gone") + 1, reach + 1)))
    return rows.where(F.col("subs") <= F.get("most", F.col("gone"))).drop("most", "_at")


def _most(left: Column, more: Column, reach: int) -> Column:
    """Letters that may be changed, by how many of the longer text's own are left out, where it has ``more`` than the other."""
    return F.array(*[F.when(F.lit(i) >= more, left - 2 * i + more).otherwise(-1) for i in range(reach + 1)])


def near_parts(have: DataFrame, want: DataFrame) -> DataFrame:
    """(vault, n, part, own, off): parts of names (vault, n, part) and of wanted texts (vault, n, own, more) within one edit."""
    left = variants(have.distinct().withColumn("most", F.array(F.lit(1), F.lit(0))), "part", 1)
    right = variants(want.distinct().withColumn("most", _most(F.lit(1), F.col("more"), 1)), "own", 1).withColumnRenamed("gone", "extra")
    right = right.select("vault", "n", "key", "own", "extra", (F.col("extra") - F.col("more")).alias("gone"))
    off = F.min(F.col("subs") + F.col("gone") + F.col("extra")).alias("off")
    return left.join(right, ["vault", "n", "key", "gone"]).groupBy("vault", "n", "part", "own").agg(off)


def near_names(names: DataFrame, want: DataFrame, most: int, reach: int) -> DataFrame:
    """(vault, y, name): of names (vault, name, low) within ``reach`` edits (1 to 3) of a text (vault, y) at least its ``most`` first, by distance and name.

    Names are halved, wanted texts cut near there; one half is within an edit. Where few names and texts share a half they
    are compared. Where many do, names and texts meet by what is left of the other half once changed and surplus letters
    are taken out: such a key fixes the distance, so the ``most`` first names of a key are enough, however many it has.
    """
    half = F.floor(F.length("low") / 2).cast("int")
    names = names.select("vault", "name", "low", F.length("low").alias("n"), F.substring("low", F.lit(1), half).alias("head"), F.substring("low", half + 1, F.length("low")).alias("tail"))
    lengths = F.broadcast(names.select("vault", "n").distinct())  # some hundred a vault
    m = F.length("y")
    cut = want.select("vault", "y", F.explode(F.sequence(m - reach, m + reach)).alias("n")).join(lengths, ["vault", "n"], "left_semi")
    cut = cut.withColumn("_h", F.floor(F.col("n") / 2).cast("int"))
    cut = cut.withColumn("_p", F.explode(F.sequence(F.col("_h") - reach, F.col("_h") + reach))).where((F.col("_p") >= 0) & (F.col("_p") <= m))
    cut = cut.select("vault", "n", "y", F.substring("y", F.lit(1), F.col("_p")).alias("head"), F.substring("y", F.col("_p") + 1, m).alias("tail"), (F.col("_p") - F.col("_h")).alias("head_more"), (m - F.col("n") - F.col("_p") + F.col("_h")).alias("tail_more"))
    cut = cut.where(F.abs("head_more") + F.abs("tail_more") <= reach)
    found = []
    for side, other in (("head", "tail"), ("tail", "head")):
        have = names.select("vault", "n", F.col(side).alias("part"), F.col(other).alias("rest"), "name", "low")
        asked = cut.select("vault", "n", "y", F.col(side).alias("own"), F.col(f"{side}_more").alias("more"), F.col(other).alias("rest"), F.col(f"{other}_more").alias("rest_more")).where(F.abs("more") <= 1)
        pairs = near_parts(have.select("vault", "n", "part"), asked.select("vault", "n", "own", "more"))
        asked = stage(asked.join(pairs, ["vault", "n", "own"]).select("vault", "n", "part", "y", "rest", "rest_more", (reach - F.col("off")).alias("left")), "hint-halves").where(F.abs("rest_more") <= F.col("left"))
        key = ["vault", "n", "part"]
        room = [F.max(F.when(F.lit(d) + F.col("rest_more") >= 0, F.col("left") - 2 * d - F.col("rest_more")).otherwise(-1)) for d in range(reach + 1)]
        groups = asked.groupBy(*key).agg(F.count("*").alias("ny"), F.max("left").alias("left"), F.array(*room).alias("most"))
        groups = groups.join(have.groupBy(*key).agg(F.count("*").alias("nx")), key)
        long = F.col("n") - F.length("part")
        work = 1 + sum(F.when(F.col("left") >= k, F.pow(2 * long, F.lit(k)) / f).otherwise(0) for k, f in ((1, 1), (2, 2), (3, 6)))
        groups = stage(groups.withColumn("many", F.col("nx") * F.col("ny") > 4 * (F.col("nx") + F.col("ny")) * work), "hint-groups")
        few, many = groups.where("not many").select(*key), groups.where("many").select(*key, "most")
        close = asked.join(few, key).select(*key, "y").distinct().join(have, key).where(F.levenshtein("low", "y", reach) >= 0)
        found.append(close.select("vault", "y", "name"))
        first = F.dense_rank().over(Window.partitionBy(*key, "key", "gone").orderBy("name"))  # one name may give a key twice
        left = variants(have.join(many, key).select(*key, "rest", "name", "most"), "rest", reach)
        left = left.withColumn("_r", first).where(F.col("_r") <= most).select(*key, "key", "gone", "name").distinct()
        right = asked.join(many.select(*key), key).withColumn("most", _most(F.col("left"), F.col("rest_more"), reach))
        right = variants(right.select(*key, "y", "rest", "rest_more", "left", "most"), "rest", reach).withColumnRenamed("gone", "extra")
        right = right.select(*key, "key", "y", (F.col("extra") - F.col("rest_more")).alias("gone")).distinct()
        found.append(right.join(left, [*key, "key", "gone"]).select("vault", "y", "name").distinct())
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def grams(size: int) -> Column:
    """The different runs of as many letters of ``t`` as ``size`` (a column of 1 ... ``size``) says."""
    runs = [f"WHEN size = {k} THEN array_distinct(transform(sequence(1, length(t) - {k} + 1), i -> substring(t, i, {k})))" for k in range(1, size + 1)]
    return F.expr(f"CASE {' '.join(runs)} END")


def within(inner: DataFrame, outer: DataFrame, size: int = 3) -> DataFrame:
    """(inner, outer): pairs of texts (vault, t) of which one lies in the other, by the rarest run of ``size`` letters.

    Texts shorter than ``size`` look for their own length; a text's rarest run bounds what it is compared with.
    """
    short = F.least(F.length("t"), F.lit(size))
    asked = inner.where("t <> ''").select("vault", "t", short.alias("size"))
    asked_sizes = F.broadcast(asked.select("vault", "size").distinct())  # three rows a vault
    has = outer.select("vault", "t", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("size")).where(F.length("t") >= F.col("size")).join(asked_sizes, ["vault", "size"], "left_semi")
    has = stage(has.select("vault", "t", "size", F.explode(grams(size)).alias("g")), "hint-grams")
    counts = has.groupBy("vault", "size", "g").agg(F.count("*").alias("c"))
    own = asked.select("vault", "t", "size", F.explode(grams(size)).alias("g"))
    rare = own.join(counts, ["vault", "size", "g"], "left").groupBy("vault", "t", "size").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("r"))
    rare = rare.where("r.c > 0").select("vault", F.col("t").alias("inner"), "size", F.col("r.g").alias("g"))
    return rare.join(has.withColumnRenamed("t", "outer"), ["vault", "size", "g"]).where(F.contains("outer", "inner")).select("vault", "inner", "outer")


def closest_all(names: DataFrame, wanted: DataFrame, most: int = 3, reach: int = 3) -> DataFrame:
    """(vault, wanted, name, distance): for every wanted text (vault, wanted) what ``closest`` finds among its vault's names.

    Pairs within ``reach`` edits come from ``near_names``, pairs of which one lies in the other meet by a rare run of
    letters; the distance is checked last. Empty texts find nothing.
    """
    names = names.select("vault", "name").where(comparable(F.col("name"))).distinct().withColumn("low", F.lower("name"))
    asked = wanted.select("vault", "wanted").where(comparable(F.col("wanted")) & (F.col("wanted") != "")).distinct().withColumn("low", F.lower("wanted"))
    names, asked = stage(names, "hint-names"), stage(asked, "hint-wanted")
    low = lambda df: stage(df.select("vault", F.col("low").alias("t")).distinct(), "hint-texts")
    have, want = low(names), low(asked)
    near = near_names(names, want.select("vault", F.col("t").alias("y")), most, reach)
    inside = within(want, have).select("vault", F.col("inner").alias("y"), F.col("outer").alias("low"))
    around = within(have, want).select("vault", F.col("outer").alias("y"), F.col("inner").alias("low"))
    held = inside.unionByName(around).distinct().join(names, ["vault", "low"]).select("vault", "y", "name")
    pairs = near.unionByName(held).distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.col("y")))
    pairs = pairs.where((F.col("distance") <= reach) | F.contains(F.lower("name"), F.col("y")) | F.contains(F.col("y"), F.lower("name")))
    turn = F.row_number().over(Window.partitionBy("vault", "y").orderBy("distance", "name"))
    best = pairs.withColumn("_r", turn).where(F.col("_r") <= most)
    return best.join(asked.withColumnRenamed("low", "y"), ["vault", "y"]).select("vault", "wanted", "name", "distance")
