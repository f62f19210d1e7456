"""Note URIs as columns: parts, diagnostics and canonical form, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import stage

#: Fixed value: the scheme that links use.
SCHEME = "obsidian"
_URI = rf"(?is)^{SCHEME}://([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_BAD_PERCENT = "%(?![0-9a-fA-F]{2})"
#: Diagnostics by the status they lead to, the gravest first.
MALFORMED = ("malformed_uri", "malformed_percent_encoding", "missing_query", "missing_vault", "missing_file", "duplicate_query_param", "invalid_subpath")
INVALID = ("invalid_path",)
UNSUPPORTED = ("unsupported_action", "unsupported_shorthand", "path_override", "fragment", "unknown_query_param", "non_markdown_target")
WARNINGS = ("empty_query_segment", "raw_plus_as_space", "markdown_extension_present", "noncanonical_uri")


def encode(text: Column) -> Column:
    """Percent-encoded component: only letters, digits and - . _ ~ stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(vault: Column, file: Column, subpath: Column) -> Column:
    bare = F.regexp_replace(file, r"(?i)\.md$", "")
    whole = F.concat(bare, F.coalesce(F.concat(F.lit("#"), subpath), F.lit("")))
    return F.concat(F.lit(f"{SCHEME}://open?vault="), encode(vault), F.lit("&file="), encode(whole))


def _bad_utf8(raw: Column, decoded: Column) -> Column:
    """Whether the percent-encoded bytes aren't UTF-8: decoding puts a replacement character that the text didn't have."""
    return F.contains(decoded, F.lit("\ufffd")) & ~F.contains(raw, F.lit("\ufffd")) & ~F.contains(F.upper(raw), F.lit("%EF%BF%BD"))


def parse(df: DataFrame, column: str = "uri") -> DataFrame:
    """Add uri_vault, uri_file, subpath, codes, canonical_uri, noncanonical and parser_status (null if sound)."""
    u = F.col(column)
    query, action = F.regexp_extract(u, _URI, 2), F.lower(F.regexp_extract(u, _URI, 1))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    out = df.withColumns({"_ok": u.rlike(_URI), "_query": query, "_action": action, "_parts": parts})
    out = out.withColumn("_names", F.transform("_parts", lambda p: F.substring_index(p, "=", 1)))

    def value(name: str) -> Column:
        own = F.get(F.filter("_parts", lambda p: F.substring_index(p, "=", 1) == name), F.lit(0))
        raw = F.when(F.contains(own, F.lit("=")), F.expr("substring({0}, locate('=', {0}) + 1)".replace("{0}", f"get(filter(_parts, p -> substring_index(p, '=', 1) = '{name}'), 0)"))).otherwise("")
        raw = F.when(own.isNotNull() & ~raw.rlike(_BAD_PERCENT), raw)
        decoded = F.try_url_decode(raw)  # a raw + is a blank
        return F.when(~_bad_utf8(raw, decoded), decoded)

    out = out.withColumns({"uri_vault": value("vault"), "_file": value("file")})
    hashed = F.contains("_file", F.lit("#"))
    out = out.withColumns({
        "uri_file": F.substring_index("_file", "#", 1),
        "subpath": F.when(hashed, F.expr("substring(_file, locate('#', _file) + 1)")),
    })
    f = F.col("uri_file")
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    unsafe = f.rlike(r"(^/)|(^|/)\.{1,2}(/|$)|^[A-Za-z]:|\\|\x00|//|/$")
    has_file = ~blank(f)
    extension = F.regexp_extract(f, r"\.([A-Za-z0-9]+)$", 1)
    values = F.transform("_parts", lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))
    rules = [
        (~F.col("_ok"), "malformed_uri"),
        (F.col("_ok") & (F.col("_action") != "open") & F.col("_action").startswith("open/"), "unsupported_shorthand"),
        (F.col("_ok") & (F.col("_action") != "open") & ~F.col("_action").startswith("open/"), "unsupported_action"),
        (F.col("_ok") & F.contains(u, F.lit("#")), "fragment"),
        (F.col("_ok") & (F.col("_query") == ""), "missing_query"),
        (F.col("_ok") & F.col("_query").rlike("(^&)|(&&)|(&$)"), "empty_query_segment"),
        (F.size(F.array_distinct("_names")) < F.size("_names"), "duplicate_query_param"),
        (F.array_contains("_names", "path"), "path_override"),
        (F.exists("_names", lambda n: ~n.isin("vault", "file", "path")), "unknown_query_param"),
        (F.exists(values, lambda v: v.rlike(_BAD_PERCENT) | _bad_utf8(v, F.try_url_decode(F.regexp_replace(v, _BAD_PERCENT, "")))), "malformed_percent_encoding"),
        (F.exists(values, lambda v: F.contains(v, F.lit("+"))), "raw_plus_as_space"),
        (F.col("_ok") & blank(F.col("uri_vault")), "missing_vault"),
        (F.col("_ok") & blank(f), "missing_file"),
        (F.coalesce(F.col("subpath") == "", F.lit(False)), "invalid_subpath"),
        (has_file & unsafe, "invalid_path"),
        (has_file & (extension != "") & (F.lower(extension) != "md"), "non_markdown_target"),
        (has_file & (F.lower(extension) == "md"), "markdown_extension_present"),
    ]
    out = out.withColumn("codes", F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules])))
    among = lambda codes: F.arrays_overlap("codes", F.array(*[F.lit(c) for c in codes]))
    sound = ~among((*MALFORMED, *INVALID, *UNSUPPORTED))
    out = out.withColumn("canonical_uri", F.when(sound, canonical(F.col("uri_vault"), f, F.col("subpath"))))
    out = out.withColumn("codes", F.when(F.col("canonical_uri") != u, F.array_append("codes", F.lit("noncanonical_uri"))).otherwise(F.col("codes")))
    status = F.when(among(MALFORMED), "malformed").when(among(INVALID), "invalid_path").when(among(UNSUPPORTED), "unsupported")
    out = out.withColumns({"noncanonical": among(WARNINGS), "parser_status": status})
    return out.drop("_ok", "_query", "_action", "_parts", "_names", "_file")


#: Fixed values, formats: a fence of three or more of one mark, closed by as many or more alone on a line; code between
#: equal runs of backticks on a line, unless a backslash stands ahead; an inline link, with an optional title.
_FENCES = [rf"(?:^ {{0,3}}({m}{{3,}}+)[^\n]*.*?(?:^ {{0,3}}\{k}{m}*[^\S\n]*$|\z))" for k, m in ((3, "`"), (4, "~"))]
CODE = rf"(?sdm)(.*?)({_FENCES[0]}|{_FENCES[1]}|(?:(?<![`\\])|(?<=\\`))(`++)[^\n]+?(?<!`)\5(?!`)|\z)"
LINK = rf"""(?sdi)(.*?)(!?\[([^\]\n]*)\]\(\s*(?:<({SCHEME}://[^>\s]+)>|({SCHEME}://[^\s)>]+))(?:\s+(?:"[^"]*"|'[^']*'|\([^)]*\)))?\s*\)|\z)"""


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "ab")).cast("long")


def pieces(rows: DataFrame, column: str, pattern: str, *groups: int) -> DataFrame:
    """(_id, _k, at, to, line, col, g...): what ``pattern`` (what is ahead, what is found, ...) finds, where it starts and ends.

    Places are sums over the pieces ahead in the text, so no text is copied for each find.
    """
    found = [F.regexp_extract_all(column, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2, *groups)]
    each = rows.select("_id", F.posexplode(F.arrays_zip(*found)).alias("_k", "p")).select("_id", "_k", "p.*")
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    tail = lambda c: units(F.substring_index(c, "\n", -1))
    ahead = Window.partitionBy("_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_u", units(F.col("g1")) + units(F.col("g2"))).withColumn("_before", F.coalesce(F.sum("_u").over(ahead), F.lit(0)))
    each = each.withColumns({"at": F.col("_before") + units(F.col("g1")), "to": F.col("_before") + F.col("_u"), "_l1": lines("g1"), "_l2": lines("g2")})
    # where the last line feed ends, within what is ahead of the find, or within the find
    each = each.withColumn("_e1", F.when(F.col("_l1") > 0, F.col("at") - tail("g1"))).withColumn("_e2", F.when(F.col("_l2") > 0, F.col("to") - tail("g2")))
    last = F.greatest(F.max("_e1").over(upto), F.max("_e2").over(ahead), F.lit(0))
    line = F.sum("_l1").over(upto) + F.coalesce(F.sum("_l2").over(ahead), F.lit(0)) + 1
    return each.withColumns({"line": line, "col": F.col("at") - last + 1}).where("g2 <> ''").select("_id", "_k", "at", "to", "line", "col", *[f"g{g}" for g in (2, *groups)])


def uri_places(notes: DataFrame, column: str = "raw", keep: tuple[str, ...] = ("vault", "path")) -> DataFrame:
    """``keep``, ord, uri, label, line, col, at: inline markdown links to note URIs that start outside code, not images.

    Lines and columns count from 1, ``at`` from 0, columns and ``at`` in UTF-16 units. Fences carry over lines until a
    closing one or the end; code spans end on their line.
    """
    # texts that have any, written once: their numbers must be the same wherever they are read
    some = notes.where(F.col(column).rlike(f"(?i){SCHEME}://")).select(F.monotonically_increasing_id().alias("_id"), *keep, column)
    some = stage(some, "uri-texts")
    links = pieces(some, column, LINK, 3, 4, 5).where(~F.col("g2").startswith("!"))
    code = pieces(some, column, CODE).select("_id", "at", "to")
    both = links.withColumn("end", F.lit(0).cast("long")).drop("to").unionByName(code.select("_id", "at", F.col("to").alias("end")), allowMissingColumns=True)
    masked = F.max("end").over(Window.partitionBy("_id").orderBy("at", F.col("_k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    free = both.withColumn("_m", masked).where(F.col("_k").isNotNull() & (F.col("_m") <= F.col("at")))
    uri = F.when(F.col("g4") != "", F.col("g4")).otherwise(F.col("g5"))
    free = free.select("_id", F.col("_k").alias("ord"), uri.alias("uri"), F.col("g3").alias("label"), F.col("line").cast("long").alias("line"), "col", "at")
    return free.join(some.select("_id", *keep), "_id").select(*keep, "ord", "uri", "label", "line", "col", "at")


def note_uris(notes: DataFrame, column: str = "raw", keep: tuple[str, ...] = ("vault", "path")) -> DataFrame:
    """``keep``, ord, uri of ``uri_places``."""
    return uri_places(notes, column, keep).select(*keep, "ord", "uri")
