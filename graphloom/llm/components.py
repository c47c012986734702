"""Connected components of an edge table, by alternating star contractions.

Each round links every node's larger neighbours to its least neighbour (large star), then its
smaller neighbours to the least of them (small star), until only stars are left: then every edge joins a
node to the least node of its component. Both steps are a minimum per node and a join back, so a
node with very many neighbours is summed before the shuffle and split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its least node."""
    now = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a").select("a", "b", "m")
        small = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = scratch.table(small, name)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node is the larger end of one edge at most, and then the smaller end of none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.filter("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0] == 0
