"""Connected components of a graph of long ids by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import dropped, scratch, stage


def _state(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first()
    return tuple(got)


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): root is the smallest node of the component.

    Each round halves distances: every node hands its larger neighbours, then its smaller ones, to the smallest it
    knows. Edges stay within their number; minima are summed on the map side before each shuffle and written before
    they are joined, so that a hot node's side of a join is a plain shuffle, which adaptive execution splits. Each round
    is written to the shared folder: no lost executor stops it. What a round has read goes when it is done. Raises if
    ``most_rounds`` don't suffice.
    """
    with scratch() as keep:
        edges = keep(_settled(edges, most_rounds))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame, most_rounds: int) -> DataFrame:
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "cc-edges")
    state = _state(edges)
    if not state[0]:
        return edges
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "cc-large")  # a > b now
        dropped(least, edges)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "cc-edges")
        dropped(least, large)
        now = _state(edges)
        if now == state:
            return edges
        state = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")
