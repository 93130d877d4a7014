"""Connected components of a link table, by alternating large-star and small-star steps.

The centre of a star may hold a third of all links. Every step that meets a node's links spreads them over ``parts``
tasks, more of them the more links there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one part of a node holds at most, where one node has them all.
PART = 250_000


def _is_star(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, and none of those has one itself."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.unionByName(chained).isEmpty()


def _with_least(edges: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest ``v`` of their ``u`` as ``m``, and (u, m). A node meets its links in ``parts`` pieces."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    some = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = some.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("held"))
    return dealt.join(least.select("u", "m", F.explode("held").alias("part")), ["u", "part"]).select("u", "v", "m"), least.select("u", "m")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node ties its larger neighbours to its smallest neighbour or itself."""
    tied, _ = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts)
    return tied.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    tied, least = _with_least(edges, parts)
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Links may repeat and stand in either direction; links of a node to itself and links with a null are left out. Each
    round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges, "edges")
    while not _is_star(edges):
        parts = 16 + edges.count() // PART
        edges = written(_small_star(_large_star(edges, parts), parts).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
