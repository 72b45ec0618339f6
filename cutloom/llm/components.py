"""Connected components of an edge table, by large-star and small-star rounds.

Every node points to the least node it knows of; a round makes each node's larger neighbours point
to that node's least neighbour, then its smaller ones. The number of rounds grows with the logarithm
of the longest chain. Edges live in staged tables; only counts reach the driver.

The rounds keep what is connected, so they are over exactly when the edges are stars: every node points
to one other, and no node that is pointed to points on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import drop_folder, staged

MOST_ROUNDS = 60


def are_stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (a to b) are stars around the nodes b."""
    # A node that points on or is pointed from by a pointed one shows twice: as many pointing nodes as edges, none of them pointed to.
    both = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    seen = both.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame, at: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root) for each node of an edge; the root is the least node of its component.

    Edges of a node to itself and empty tables give nothing; repeated edges count once. Fails if ``most_rounds`` don't suffice.
    """
    star = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{at}/edges-0")
    k = 0
    while not are_stars(star):
        k += 1
        if k > most_rounds:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        star = staged(small.distinct(), f"{at}/edges-{k}")
        drop_folder(edges.sparkSession, f"{at}/edges-{k - 1}")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
