"""Connected components by large-star and small-star rounds over an edge table.

Every round is written to the shared folder, so lineage stays short and a lost executor
costs one round. Work and data are those of the edges only; nothing is collected but two
sums. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import session

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(ends))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or itself)."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    ``edges`` has columns a and b of one type; loops and repeated edges do no harm, an empty
    table gives an empty result.
    """
    nodes = session.save(edges.where("a is not null and b is not null").select("a", "b"), "edges")
    now, before = nodes.where("a <> b"), None
    for _ in range(MAX_ROUNDS):
        now = session.save(_small_star(_large_star(now)), "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(now.select("b", "b").distinct()).distinct()
