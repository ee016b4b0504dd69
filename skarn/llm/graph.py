"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Each round replaces edges so that nodes point to smaller neighbours until the
    edges are stars around the roots; a checksum over the edges tells when they no
    longer change. Minima are grouped aggregates joined back, so a node with very
    many neighbours is split like any skewed join. Rounds are written tables.
    """
    same = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum("b")).first())

    before = mark(same)
    for k in range(1, max_rounds + 1):
        both = same.union(same.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # here b < a always
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        same = scratch.write(small, f"{name}{k}")
        now = mark(same)
        if k > 1:
            scratch.drop(f"{name}{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return same.select(F.col("a").alias("node"), F.col("b").alias("root")).union(same.select("b", "b").distinct())
