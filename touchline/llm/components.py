"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage

#: Rounds double what a node has seen, so this is far more than any graph needs; reaching it raises.
MAX_ROUNDS = 60


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    # The negated key makes Spark deal both sides anew, so that adaptive execution can split a hot node.
    return edges.withColumn("_k", F.bitwise_not("u")).join(least.select(F.bitwise_not("u").alias("_k"), "m"), "_k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _star(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. ``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _star(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` can reach; least nodes themselves have no row.

    Links are undirected; loops, repeats and nulls are ignored; no links give no rows. Each round is written to the
    shared checkpoint folder, and rounds end when the links no longer change (compared by count and hash sums).
    """
    edges = cut_lineage(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError("components did not settle")
