"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostgauge.session import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``edges`` (a, b: bigint) but the roots.

    Each round hangs every node below the smallest neighbour of its neighbours;
    a round that changes nothing ends it (a few rounds, as the logarithm of the
    longest path). Rounds are reliable checkpoints. Minima are combined before
    the shuffle and stored, so that a hub's edges meet its minimum in a join that can split them.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = materialize(edges)
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least)
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        below = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        pairs = F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))
        small = large.join(below, "a").select(F.inline(pairs)).where(a != b).distinct()
        edges = materialize(small)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
