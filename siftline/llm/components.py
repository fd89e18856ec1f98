"""Connected components of a sparse link table, by alternating large and small stars.

Every round points each node's neighbours at the smallest one it knows; the number of rounds grows with the logarithm
of the longest chain. Each round is written to the shared folder, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import keep

MAX_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a < b. Large: every node points its larger neighbours at its smallest neighbour or itself;
    small: every node points its smaller neighbours and itself at its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.where("b != m").select(F.col("m").alias("a"), "b").unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component. Repeated
    links, links of a node with itself and an empty table are allowed."""
    current = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    # a star needs no round: no node is both a smaller and a larger end, and no larger end has two smaller ones
    for _ in range(max_rounds):
        twice = current.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = current.select("b").join(current.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if twice.unionAll(chained.withColumn("n", F.lit(0).cast("long"))).isEmpty():
            return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        current = keep(_star(_star(current, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
