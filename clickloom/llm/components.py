"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, has_rows, written

ROWS = 500_000  # edges to a file of the tables between steps


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node is above two others, or above one and below another."""
    ends = edges.select(F.col("low").alias("x"), F.lit(0).alias("h")).unionByName(edges.select(F.col("high").alias("x"), F.lit(1).alias("h")))
    return not has_rows(ends.groupBy("x").agg(F.sum("h").alias("h"), F.min("h").alias("below")).filter("h > 1 or (h = 1 and below = 0)"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Null ends and loops link nothing. Each step takes the smallest neighbour of every node, summed up before
    the shuffle, so that a node with very many neighbours is no hot key (the joins back to it can be split by
    adaptive execution), and writes its edges to shared storage. Ends when the edges are stars.
    """
    edges = edges.select(F.least(left, right).alias("low"), F.greatest(left, right).alias("high"))
    edges = written(edges.filter("low < high").distinct(), "edges")
    files = max(1, edges.count() // ROWS)
    while not _settled(edges):
        # large star: a node's larger neighbours move to its smallest one (or to itself)
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = F.array("high", "low")
        small = large.join(least, "high").select(F.col("m").alias("low"), F.explode(moved).alias("high"))
        before, edges = edges, written(small.filter("low < high").distinct().coalesce(files), "star")
        discard(before)
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    stars = stars.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
    stars._path = edges._path  # so `discard` deletes the edges
    return stars
