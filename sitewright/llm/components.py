"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.operators.joins import lookup
from sitewright.sources.tables import save_stage

SALTS = 64  # tasks that share the edges of a hub
HUB = 1000  # nodes with more edges than this are hubs; without any, the joins are plain


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    """Every larger neighbor of a node moves to the smallest of the node and its neighbors."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = lookup(both.filter("v > u"), lowest, "u", ["v"], how="inner", salts=salts)
    return larger.select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    """A node and its smaller neighbors move to the smallest of them."""
    lowest = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    smaller = lookup(edges, lowest, "hi", ["lo"], how="inner", salts=salts)
    moved = smaller.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct()


def _state(star: DataFrame) -> tuple[bool, bool]:
    """(settled, hub), from one aggregate over the nodes.

    Settled: every larger end has one smaller end, and no smaller end is a larger one. Hub: a node has more than ``HUB`` edges.
    """
    sides = [F.struct(F.col(side).alias("node"), F.lit(up).alias("up")) for side, up in (("hi", 1), ("lo", 0))]
    ends = star.select(F.explode(F.array(*sides)).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("edges"))
    moving = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("edges") > 1))
    row = nodes.agg(F.max(moving).alias("moving"), F.max(F.col("edges") > HUB).alias("hub")).first()
    return not row["moving"], bool(row["hub"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of its component.

    Edges are undirected; loops and repeated edges do no harm. Each round is two joins and three aggregates on
    narrow rows, with the edges of a hub spread over tasks; its result is written to the shared folder, which cuts the lineage. The number of rounds grows with
    the logarithm of the component's size.
    """
    x, y = F.col(a), F.col(b)
    star = save_stage(
        edges.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges"
    )
    while True:
        settled, hub = _state(star)
        if settled:
            break
        salts = SALTS if hub else 0
        star = save_stage(_small_star(_large_star(star, salts), salts), "edges")
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        star.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
