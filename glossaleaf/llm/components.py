"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and a join on its keys; edges are
written to the shared folder after each round, and only a count and a checksum of them
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["k"]).filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    joined = edges.join(least, edges["u"] == least["k"])
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node reached.

    Loops and repeated edges do no harm; without edges there are no rows.
    """
    ends = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(edges.filter("u <> v").select(*ends).distinct(), "edges")
    seen = _checksum(now)
    while seen[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        before, seen = seen, _checksum(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
