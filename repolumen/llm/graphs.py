"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of the edges ``(a, b)`` that are not the root themselves.

    The root is the smallest node of the component. Alternates two star steps: every
    larger neighbour of a node, then the node itself, is hung to the smallest
    neighbour. Rounds grow with the logarithm of the longest chain, each round is
    a written table. Minima are folded before they are shuffled, so a node with very
    many neighbours costs a split join only.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(lowest, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = cut_lineage(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        now = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
