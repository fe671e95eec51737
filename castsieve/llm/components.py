"""Connected components by alternating large-star and small-star steps.

Every node ends up linked to the smallest node of its component.  All steps are
partial aggregations and joins on tables in the shared folder; the number of
rounds grows with the logarithm of the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize


def components(links: DataFrame, one: str = "x", other: str = "y") -> DataFrame:
    """``node`` and ``root`` for every node that has a link; the root is the smallest node.

    Links of a node with itself and repeated links change nothing.
    """
    edges = links.where(F.col(one) != F.col(other)).select(
        F.greatest(one, other).alias("u"), F.least(one, other).alias("v")
    )
    edges = materialize(edges.distinct(), "edges")
    state = _fingerprint(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        after = _fingerprint(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.where(F.col("v") > F.col("u")).join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
