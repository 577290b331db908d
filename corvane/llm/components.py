"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import stored


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether each leads from a node with no other edge to a centre."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.bool_and(F.expr("up = 0 OR up = 1 AND down = 0")), F.lit(True))).first()
    return row[0], row[1]


def labels(edges: DataFrame, about: int | None = None) -> DataFrame:
    """(a, b) edges -> (node, label): the smallest node of each node's component, for every node that has an edge.

    A star's centre may have any number of neighbours: they are never gathered, the centre's minimum is joined to them instead.
    Each round is written to the shared folder, which cuts the lineage; no round follows once only stars are left. about: the number of edges, roughly.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", about)
    while not (state := _stars(edges))[1]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small, "edges", state[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
