"""Connected components of a graph that no task and no driver ever holds.

Alternating large-star and small-star steps (Kiveris et al., 2014), a round of
both over one written edge table. Minima are aggregated before they meet the
edges again, so a node with very many neighbours costs one row per neighbour
and no list. Rounds go on until the edges are stars, which they become after
about the square of the logarithm of the longest path.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.stage import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the larger neighbours of each node tied to its least neighbour."""
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges with each node and its smaller neighbours tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ties = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return edges.join(least, "u").select(F.inline(ties)).where("u > v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one and a larger one too."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) for each node of edges (u, v); label is the least node of the component."""
    pair = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pair = written(pair, folder, "edges")
    for k in count():
        if _are_stars(pair):
            break
        pair = written(_small_star(_large_star(pair)).distinct(), folder, f"round-{k}")
    return pair.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pair.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
