"""What is laid beside results: signals, previews, variants, completeness, digests, compatibility."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.jslike import WS, nfc, utf16_length


def with_signals(results: DataFrame, signals: DataFrame, key: str = "path", vault: str | None = "vault") -> DataFrame:
    """Results with a nullable ``graph`` struct of the signals' other columns; rows are neither lost nor moved.

    Paths meet in composed form, and by vault where both have one, so equal paths of two vaults never mix.
    """
    keys = [c for c in (vault, key) if c]
    right = signals.select(*[nfc(F.col(k)).alias(f"_{k}") for k in keys], F.struct(*[c for c in signals.columns if c not in keys]).alias("graph"))
    match = [nfc(results[k]) == right[f"_{k}"] for k in keys]
    return results.join(right, match, "left").drop(*[f"_{k}" for k in keys])


def preview(text: Column, units: int = 200) -> Column:
    """First ``units`` UTF-16 units and a mark where there is more; white space runs become one blank.

    A character of two units that the cut would halve is left out: a half is no text.
    """
    flat = F.regexp_replace(text, f"[{WS}]+", " ")
    wide = r"[\x{10000}-\x{10FFFF}]"
    # a filler behind each wide character makes places count units
    cut = F.substring(F.regexp_replace(flat, f"({wide})", "$1\uffff"), 1, units)
    cut = F.regexp_replace(F.regexp_replace(cut, wide + r"\z", ""), "\uffff", "")
    cut = F.when(F.length(flat) == utf16_length(flat), F.substring(flat, 1, units)).otherwise(cut)
    return F.when(utf16_length(flat) > units, F.concat(cut, F.lit("..."))).otherwise(flat)


def best_of_variants(hits: DataFrame, key: list[str], scores: list[str]) -> DataFrame:
    """One row a key with the best of each score over all variants of a query (expansions, hypothetical answers)."""
    return hits.groupBy(*key).agg(*[F.max(c).alias(c) for c in scores])


def compatibility(stored: DataFrame, model: str, dims: int) -> DataFrame:
    """One row: total, compatible, other_model, other_dims, reindex_required."""
    same, size = F.col("model") == model, F.size("embedding") == dims
    sums = stored.agg(
        F.count("*").alias("total"), F.count(F.when(same & size, 1)).alias("compatible"), F.count(F.when(~same, 1)).alias("other_model"), F.count(F.when(same & ~size, 1)).alias("other_dims")
    )
    return sums.withColumn("reindex_required", F.col("compatible") < F.col("total"))


def digest(notes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, files, digest: of all paths and contents, whatever their order.

    Four sums of the files' own digests merge like any sum, so no task ever sees a whole vault.
    """
    own = F.md5(F.concat(F.md5("path"), F.md5("raw")))
    parts = [F.sum(F.conv(F.substring(own, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(4)]
    return notes.groupBy(*keys).agg(F.count("*").alias("files"), F.concat_ws("-", *[p.cast("string") for p in parts]).alias("digest"))


@dataclass(frozen=True)
class Completeness:
    """Exact totals, a reached limit, or a partial scan with up to eight reasons."""

    state: str
    total: int | None = None
    returned: int | None = None
    skipped: int = 0
    reasons: tuple[str, ...] = field(default=())

    @classmethod
    def exact(cls, total: int, returned: int) -> Completeness:
        if not 0 <= returned <= total:
            raise ValueError("returned must lie between 0 and total")
        return cls("exact", total, returned)

    @classmethod
    def of_limited(cls, rows_fetched: int, limit: int) -> Completeness:
        """From one row more than the limit: whether there were more."""
        return cls("limit_reached", None, limit) if rows_fetched > limit else cls.exact(rows_fetched, rows_fetched)

    @classmethod
    def partial(cls, scanned: int, skipped: int, reasons: list[str]) -> Completeness:
        return cls("partial", None, scanned, skipped, tuple(dict.fromkeys(reasons))[:8])

    def as_dict(self) -> dict:
        out = {k: v for k, v in asdict(self).items() if v not in (None, (), 0) or k == "total"}
        if self.state == "exact":
            out |= {"returned": self.returned, "truncated": self.returned < self.total, "has_more": self.returned < self.total}
        return out


def observed(df: DataFrame, name: str, skipped: Column) -> tuple[DataFrame, object]:
    """The frame, and an observation that has scanned and skipped counts once an action ran: no second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("scanned"), F.count(F.when(skipped, 1)).alias("skipped")), seen
