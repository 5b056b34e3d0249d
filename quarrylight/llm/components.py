"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settled
from quarrylight.sources.shared import dropped


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest in the node's neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("n"))
    return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = edges.join(least, F.col("a") == F.col("n")).filter(F.col("b") != F.col("m"))
    kept = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(kept).distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node with an edge, the smallest node that it reaches.

    Alternating large and small stars (Kiveris and others, 2014) end in one star
    per component after about log(n) rounds. Each round is written to the shared
    folder, so lost executors cost one round, and the round before goes; only a count and a checksum of
    the edges come to the driver. Loops are ignored; nodes without an edge do not
    appear.
    """
    a, b = F.col(left), F.col(right)
    stars = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    stars = settled(stars, "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    for _ in range(max_rounds):
        last, stars = stars, settled(_small_star(_large_star(stars)), "stars")
        dropped(last)
        now = tuple(stars.agg(F.count(F.lit(1)), mark).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
