"""Connected components of edge tables by alternating large and small stars.

Sums over a node's edges are written to the shared folder before they are joined
back, so that each join has plain tables on both sides: Spark broadcasts a small
one by its size on disk, and else splits the partition of a node of very many
edges while the query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, remove


def _round(now: DataFrame) -> DataFrame:
    """A large star, then a small one. Edges point down (u > v).

    Large: every larger neighbour of a node is tied to the least of that node's
    neighbours and itself. Small: a node and its smaller neighbours are tied to
    the least of them.
    """
    both = now.unionByName(now.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("g", F.col("u").alias("v")).agg(F.least(F.min(F.col("v")), F.first("u")).alias("m")), "least")
    large = materialise(now.join(least, ["g", "v"]).select("g", "u", F.col("m").alias("v")).where("u <> v").distinct(), "large")
    low = materialise(large.groupBy("g", "u").agg(F.min("v").alias("m")), "low")
    tied = large.join(low, ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    small = materialise(tied.unionByName(low.select("g", "u", F.col("m").alias("v"))).distinct(), "edges")
    remove(least, large, low)
    return small


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no node has two edges down, and none that has one is led to."""
    forked = edges.groupBy("g", "u").agg(F.count("*").alias("n")).where("n > 1").select("g", "u")
    passed = edges.select("g", "u").join(edges.select("g", F.col("v").alias("u")).distinct(), ["g", "u"], "left_semi")
    return not forked.unionByName(passed).limit(1).count()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """g, node, root for every node with an edge: root is the least node of its component.

    edges: g, u, v (long); graphs of different g are apart. Rounds grow with the
    logarithm of the longest path, so that no graph that fits a disk meets
    most_rounds.
    """
    now = materialise(edges.where("u <> v").select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            roots = now.select("g", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select("g", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        now, old = _round(now), now
        remove(old)
    raise RuntimeError("connected components did not settle")
