"""Connected components of a graph which no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the least node.

    Alternating stars: each node hands its least neighbour to its larger neighbours, then
    to its smaller ones, until nothing changes, which takes about the logarithm of the
    longest path. A node's minimum is folded before the shuffle and joined back, so that a
    hub is never gathered. Every round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, seal = _sealed(pairs.distinct())
    while True:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a"), F.col("low").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        before = seal
        current, seal = _sealed(small)
        if seal == before:
            break
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select("b").distinct()
    return members.union(roots.select("b", "b"))


def _sealed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    kept = staged(edges, "stars")
    sums = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return kept, tuple(sums.first())
