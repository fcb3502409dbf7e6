"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges; a step replaces the edges, and the lineage is cut with a
written table.  A node with very many neighbours is only ever aggregated to its least neighbour (combined before the
shuffle) and joined as the one row of that minimum, whose other side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import stage

MAX_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b.  Large star: link every greater neighbour to the least neighbour; small star:
    link every smaller neighbour, and the node itself, to the least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.filter(F.col("b") > F.col("a"))
        return up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node reachable."""
    cur = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        large = _star(cur, True).filter("a <> b").distinct()
        nxt = stage(_star(large, False).filter("a <> b").distinct(), "edges")
        # A star forest: each node has one edge, and no root is itself linked further.
        roots = nxt.select(F.col("b").alias("a")).distinct()
        if not nxt.join(roots, "a", "left_semi").limit(1).count() \
                and not nxt.groupBy("a").count().filter("count > 1").limit(1).count():
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                nxt.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        cur = nxt
    raise RuntimeError("components: no fixed point")
