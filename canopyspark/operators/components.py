"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.operators.scratch import discard, written


def _stars(pairs: DataFrame) -> bool:
    """Whether each u stands in one pair of pairs and in none as v: every pair then ends at its minimum."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per_node = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is its smallest node.

    Large and small stars alternate: every node sends its neighbours to the smallest node it
    knows, until the graph is a set of stars around component minima. The minimum is aggregated with
    map-side combine, so a node with very many edges is no hot group. Rounds grow with the logarithm
    of the node count; each is written to the shared folder, which cuts the lineage.
    Null ends and self loops are ignored; no edges give no rows. The rounds run when this is called.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while not _stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        old, now = now, written(small.where("u <> v").distinct(), "components")
        discard(old)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
