"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """`node, component`: the smallest node of each connected component, for every node that occurs in `edges(a, b)`.

    Alternating large-star and small-star steps over an edge table whose size never grows; each step is two shuffles on the node
    and a hub's neighbours are never gathered, only their minimum is. The only thing the driver sees is a changed-edge count.
    Self links and repeated links are harmless; an empty table gives an empty result.
    """
    both = edges.select("a", "b").where(F.col("a") != F.col("b"))
    e = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        # Large star: link every larger neighbour of a node to the least node of its neighbourhood.
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: link every smaller neighbour, and the node itself, to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = cut(small)
        # Done when every node points at one root only and no root points further: the table is a set of stars.
        roots = new.select(F.col("v").alias("u")).distinct()
        unfinished = new.join(roots, "u", "left_semi").limit(1).count() + new.groupBy("u").count().where("count > 1").limit(1).count()
        e = new
        if not unfinished:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
