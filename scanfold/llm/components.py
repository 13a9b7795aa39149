"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.sources.tables import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of node and neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node with an edge (a, b); comp is the smallest node of its component.

    Every round halves the paths; a node with very many neighbours costs no more
    than its edges, since minima are combined before the shuffle. Rounds are
    written to the shared folder, so lineage stays short.
    """
    edges = staged(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        before, edges = edges, staged(_small_star(_large_star(edges)))
        discard(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
