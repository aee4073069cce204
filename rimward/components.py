"""Connected components of an undirected graph by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.storage import stored

#: Links of a task of a round, and how many links there are at most where lowest neighbours are broadcast.
TASK_LINKS, BROADCAST_LINKS = 10_000, 200_000


def _star(edges: DataFrame, lowest: DataFrame, smaller: bool, few: bool) -> DataFrame:
    """Links of ``edges`` (u, v) moved from u to u's lowest neighbour: those with v > u, or else those with v < u and u's own."""
    near = edges.where("v < u" if smaller else "v > u").join(F.broadcast(lowest) if few else lowest, "u")
    moved = near.select(F.col("v").alias("u"), F.col("low").alias("v"))
    if smaller:
        moved = moved.unionByName(lowest.where("low < u").select("u", F.col("low").alias("v")))
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame, tasks: int) -> bool:
    """Whether each u of ``edges`` (u, v) has one link alone and is nobody's v."""
    end = lambda c, below: F.struct(F.col(c).alias("node"), F.lit(below).alias("below"))
    ends = edges.select(F.explode(F.array(end("u", True), end("v", False))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.max("below").alias("below"), F.count(F.lit(1)).alias("n")).coalesce(tasks).where("below AND n > 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): each linked node with the lowest node of its component.

    Nodes are longs. A node's neighbours are never gathered: a round takes minima by pre-aggregated grouping
    and joins. Rounds grow with the logarithm of the longest path, and end as soon as all links form stars. Tasks are as many as the links ask for. No links give no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    n = edges.count()
    tasks, few = 1 + n // TASK_LINKS, n <= BROADCAST_LINKS
    while not _are_stars(edges, tasks):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")).coalesce(tasks)
        large = stored(_star(both, lowest, smaller=False, few=few).coalesce(tasks), "large-star", replaces=edges)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("low")).coalesce(tasks)
        edges = stored(_star(down, lowest, smaller=True, few=few).coalesce(tasks), "small-star", replaces=large)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
