"""Link graphs that another program resolved, given as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "resolved map<string, map<string, int>>, unresolved map<string, map<string, int>>"


def tolerant_json(text: Column) -> Column:
    """The JSON object of a program's output: as it is, or quoted as a JSON text, or from the first brace to the last one."""
    unquoted = F.try_variant_get(F.try_parse_json(text), "$", "string")
    inner = F.when(F.startswith(F.trim(text), F.lit('"')), unquoted)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    sound = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(sound(text), sound(inner), sound(braces))


def select_provider(parsed: DataFrame, given: DataFrame | None = None, status: str = "available", disabled: bool = False) -> tuple[DataFrame, dict]:
    """(edges, receipt): the graph that another program resolved where it can be had, else the parsed one, and why.

    ``status`` is what a probe of that program found; ``given`` its edges.
    """
    if disabled:
        why, probe = "disabled", "disabled"
    elif status != "available":
        why, probe = status if status.endswith("_unavailable") else "probe_failed", status
    elif given is None:
        why, probe = "nothing_given", status
    else:
        return given, {"provider": "given", "approximate": False, "probe": status, "reason": None}
    return parsed, {"provider": "parsed", "approximate": True, "probe": probe, "reason": why}


def edges_from_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of (vault, JSON) rows {resolved: {src: {dst: n}}, unresolved: {src: {target: n}}}.

    Edges have the schema that parsed notes give: notes only, no links to oneself. One row may hold a vault or a part.
    """
    parsed = rows.select("vault", F.from_json(tolerant_json(F.col(column)), SCHEMA).alias("j"))

    def flat(name: str, to: str) -> DataFrame:
        out = parsed.select("vault", F.explode(f"j.{name}").alias("src", "m")).select("vault", "src", F.explode("m").alias(to, "cnt"))
        return out.groupBy("vault", "src", to).agg(F.sum("cnt").alias("cnt"))

    edges = flat("resolved", "dst").where(F.col("src").endswith(".md") & F.col("dst").endswith(".md") & (F.col("src") != F.col("dst")))
    return edges, flat("unresolved", "target")
