"""Connected components by alternating large-star and small-star steps on an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node to the least of its neighbourhood: larger neighbours, or the node and smaller ones.

    The least neighbour is a partial aggregate, so a node with very many edges is
    summed up before the shuffle; the join back is one that adaptive execution can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges' first two columns; component is its least node.

    Self loops keep their node. Edges with a null end are ignored. Rounds are
    checkpointed, so a lost executor never replays earlier rounds.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = pairs.where(F.col("a") != F.col("b"))
    state = None
    for _ in range(max_rounds):
        links = cut(_star(_star(links, large=True), large=False))
        found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
