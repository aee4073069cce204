"""Graphs over nodes: edges (sample_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.delaunay import delaunay_simplices, simplex_edges
from rimward.expr import norm
from rimward.nearest import nearest_points
from rimward.schema import as_nodes, axes
from rimward.storage import stored


def knn_edges(nodes: DataFrame, k: int) -> DataFrame:
    """Directed edges from each node to its k nearest others; ties go to the smaller id."""
    nodes = as_nodes(nodes)
    if k < 1 or nodes.groupBy("sample_id").count().where(F.col("count") <= int(k)).limit(1).count():
        raise ValueError(f"k={k} needs at least 1 and more than k nodes in every sample.")
    return nearest_points(nodes, nodes, int(k), exclude_same_id=True).select("sample_id", F.col("node_id").alias("src"), F.col("point_id").alias("dst"))


def rnn_edges(nodes: DataFrame, r: float) -> DataFrame:
    """Undirected edges between nodes at a distance of r or less, by an equi-join of cells of width r with their neighbours."""
    nodes = as_nodes(nodes)
    names = axes(nodes)
    if r < 0:
        raise ValueError("r must not be negative.")
    cell = [F.floor(F.col(a) / r).alias(f"c{a}") if r > 0 else F.col(a).alias(f"c{a}") for a in names]
    held = nodes.select("sample_id", F.col("node_id").alias("dst"), *[F.col(a).alias(f"p{a}") for a in names], *cell)
    spread = nodes.select("sample_id", F.col("node_id").alias("src"), *names, *cell)
    if r > 0:
        for a in names:
            spread = spread.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"c{a}") - 1, F.col(f"c{a}") + 1)))
    near = norm([F.col(a) - F.col(f"p{a}") for a in names]) <= r
    return spread.join(held, ["sample_id", *[f"c{a}" for a in names]]).where(F.col("src") < F.col("dst")).where(near).select("sample_id", "src", "dst")


def delaunay_edges(nodes: DataFrame) -> DataFrame:
    """Undirected edges of the Delaunay triangulation in the plane or in space. Nodes on one circle or sphere are fanned from the smallest id."""
    nodes = as_nodes(nodes, (2, 3), "The Delaunay graph needs nodes with two or three coordinates.")
    edges = stored(simplex_edges(delaunay_simplices(nodes)), "delaunay-edges")
    if nodes.select("sample_id").distinct().join(edges, "sample_id", "left_anti").limit(1).count():
        raise ValueError("degenerate point set: too few nodes in a sample, or all of them on a line or in a plane")
    return edges


def construct_graph(nodes: DataFrame, graph_type: str, k: int | None = None, r: float | None = None) -> DataFrame:
    """Edges of the graph named ``delaunay``, ``knn`` (needs k) or ``rnn`` (needs r)."""
    if graph_type == "delaunay":
        return delaunay_edges(nodes)
    if graph_type == "knn":
        if k is None:
            raise ValueError("k is required for a knn graph.")
        return knn_edges(nodes, k)
    if graph_type == "rnn":
        if r is None:
            raise ValueError("r is required for an rnn graph.")
        return rnn_edges(nodes, r)
    raise ValueError(f"There is no graph named {graph_type!r}; choose delaunay, knn or rnn.")
