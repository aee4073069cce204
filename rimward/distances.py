"""Distances of nodes to the border of their sample. Each operator gives (sample_id, node_id, <name>)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.components import connected_components
from rimward.delaunay import delaunay_triangles, triangle_edges
from rimward.expr import clip, segment_distance, triangle_distance
from rimward.geometry import hull_2d, hull_facets_3d
from rimward.nearest import DIRECT_ROWS, nearest_points
from rimward.pieces import least_gap
from rimward.schema import as_nodes, axes, with_sample
from rimward.storage import stored
from rimward.transform import mask_gaps

RECTANGLE, POINTSET, MASK, HULL, ALPHA, TRIANGLES = (
    f"distance_to_{n}" for n in ("rectangular_border", "pointset", "mask", "convex_hull", "alpha_shape", "triangles")
)
#: Hulls of this many points or fewer go from each task to the next step.
CHUNK = 20_000
#: Masks with a True pixel in so many, and more than ``DIRECT_ROWS`` of them, are transformed; thinner ones are searched as points.
THIN = 32


def distance_to_rectangular_border(nodes: DataFrame) -> DataFrame:
    """Distance to the nearest side of the nodes' own bounding box, in the plane."""
    nodes = as_nodes(nodes, (2,), "Nodes need two coordinates (Nx2).")
    box = nodes.groupBy("sample_id").agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xy" for f in (F.min, F.max)])
    nearest = F.least(F.col("x") - F.col("min_x"), F.col("max_x") - F.col("x"), F.col("y") - F.col("min_y"), F.col("max_y") - F.col("y"))
    return nodes.join(box, "sample_id").select("sample_id", "node_id", nearest.alias(RECTANGLE))


def distance_to_pointset(nodes: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Euclidean distance to the nearest landmark (x, y[, z][, sample_id]); landmarks without sample_id serve every sample."""
    nodes = as_nodes(nodes)
    if axes(nodes) != axes(landmarks):
        raise ValueError("Landmarks and nodes differ in dimensionality.")
    if landmarks.limit(1).count() == 0:
        raise ValueError("There must be at least one landmark.")
    marks = landmarks.select(*(["sample_id"] if "sample_id" in landmarks.columns else []), *[F.col(a).cast("double") for a in axes(nodes)]).distinct()
    marks = marks.withColumn("node_id", F.xxhash64(*axes(nodes)))
    near = nearest_points(nodes, marks, 1, exclude_same_id=False)
    return near.select("sample_id", "node_id", F.col("distance").alias(POINTSET))


def distance_to_mask(nodes: DataFrame, mask: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Distance in pixels from a node's pixel to the nearest True pixel, 0 within the mask.

    ``mask`` holds the True pixels (i, j[, k][, sample_id]); rows outside the shape aren't pixels of it. Coordinates are rounded half to even and
    clipped to the shape. Dense masks are transformed axis by axis, thin ones searched as points; both are exact.
    """
    nodes = as_nodes(nodes)
    names, index = axes(nodes), [c for c in ("i", "j", "k") if c in mask.columns]
    if len(names) != len(shape) or len(index) != len(shape):
        raise ValueError("The mask and the nodes differ in dimensionality.")
    of = ["sample_id"] if "sample_id" in mask.columns else []
    on = mask.select(*[F.col(c).cast("string") for c in of], *[F.col(i).cast("long") for i in index])
    for i, n in zip(index, shape, strict=True):
        on = on.where(F.col(i).between(0, n - 1))
    pixels, masks = on.agg(F.count(F.lit(1)), F.count_distinct(*of) if of else F.lit(1)).first()
    if pixels == 0:
        raise ValueError("The mask has no True pixel.")
    pixel = [clip(F.rint(a), F.lit(0.0), F.lit(float(n - 1))).cast("long").alias(i) for a, i, n in zip(names, index, shape, strict=True)]
    at = nodes.select("sample_id", "node_id", *pixel)
    if pixels > DIRECT_ROWS and pixels * THIN >= masks * math.prod(shape):
        gaps = mask_gaps(at.select(*of, *index).distinct(), on, shape)
        return at.join(gaps, [*of, *index]).select("sample_id", "node_id", F.sqrt("square").alias(MASK))
    points = lambda df: df.select(*[c for c in df.columns if c not in index], *[F.col(i).cast("double").alias(a) for i, a in zip(index, names, strict=True)])
    found = distance_to_pointset(points(at.select("sample_id", *index).distinct().withColumn("node_id", F.xxhash64(*index))), points(on))
    keyed = at.withColumn("cell", F.xxhash64(*index)).join(found.withColumnRenamed("node_id", "cell"), ["sample_id", "cell"])
    return keyed.select("sample_id", "node_id", F.col(POINTSET).alias(MASK))


def mask_pixels(rows: DataFrame, column: str = "mask") -> DataFrame:
    """The True pixels (i, j) of masks held as array<array<boolean>>."""
    keep = ["sample_id"] if "sample_id" in rows.columns else []
    lines = rows.select(*keep, F.posexplode(column).alias("i", "line"))
    return lines.select(*keep, "i", F.posexplode("line").alias("j", "on")).where("on").drop("on")


def _hull_rows(points: np.ndarray) -> np.ndarray:
    """Indices of the rows on the hull's corners; all of them if there's no proper hull."""
    if points.shape[1] == 2:
        found = hull_2d(points)
        return found
    facets = hull_facets_3d(points)
    return np.unique(np.concatenate(facets)) if facets else np.arange(len(points))


def hull_corners(nodes: DataFrame) -> DataFrame:
    """The corners of each sample's hull: tasks reduce chunks to their hulls, and only those corners go on."""
    names = axes(nodes)

    def reduce_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for frame in frames:
            for sample, rows in frame.groupby("sample_id"):
                rows = pd.concat([held[sample], rows]) if sample in held else rows
                rows = rows.drop_duplicates(names)
                parts = [rows.iloc[i : i + CHUNK] for i in range(0, len(rows), CHUNK)]
                held[sample] = pd.concat([p.iloc[_hull_rows(p[names].to_numpy())] for p in parts])
        yield from held.values()

    def reduce_all(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id").drop_duplicates(names)
        return rows.iloc[_hull_rows(rows[names].to_numpy())]

    first = nodes.mapInPandas(reduce_chunks, nodes.schema)
    return first.groupBy("sample_id").applyInPandas(reduce_all, nodes.schema)


def hull_facets(nodes: DataFrame) -> DataFrame:
    """(sample_id, facet array<array<double>>): the hull's edges in the plane, or in space its facets' first corner, unit normal and box."""
    names = axes(nodes)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("node_id")[names].to_numpy()
        if p.shape[1] == 2:
            ring = hull_2d(p)
            found = [[p[i].tolist(), p[j].tolist()] for i, j in zip(ring, np.roll(ring, -1), strict=True)] if len(ring) > 2 else []
        else:
            found = []
            for f in hull_facets_3d(p):
                normal = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
                corners = p[list(f)]
                found.append([p[f[0]].tolist(), (normal / np.linalg.norm(normal)).tolist(), corners.min(axis=0).tolist(), corners.max(axis=0).tolist()])
        return pd.DataFrame({"sample_id": rows["sample_id"].iloc[0], "facet": pd.Series(found, dtype=object)})

    return hull_corners(nodes).groupBy("sample_id").applyInPandas(build, "sample_id string, facet array<array<double>>")


def distance_to_triangles(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Distance in space to the nearest of a sample's triangles: rows (sample_id, a, b, c), each corner an array of x, y and z.

    Above a triangle that's the distance to its plane, elsewhere to its nearest side; a triangle without area is its sides. Samples without
    triangles give no rows.
    """
    nodes = as_nodes(nodes, (3,), "Distances to triangles need nodes with three coordinates.")
    corners = with_sample(triangles).select("sample_id", F.struct("a", "b", "c").alias("triangle"))
    at = lambda corner: [corner[k].cast("double") for k in range(3)]
    gap = lambda t: triangle_distance([F.col(a) for a in "xyz"], at(t["a"]), at(t["b"]), at(t["c"]))
    return least_gap(nodes, corners, "triangle", gap, lambda t: [at(t[c]) for c in "abc"]).withColumnRenamed("gap", TRIANGLES)


def distance_to_convex_hull(nodes: DataFrame) -> DataFrame:
    """Distance to the boundary of the convex hull. Samples of no more nodes than dimensions are all border: 0."""
    nodes = as_nodes(nodes, (2, 3), "Nodes need two or three coordinates (Nx2, Nx3).")
    names = axes(nodes)
    facets = stored(hull_facets(nodes), "facets")
    counts = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    flat = counts.where(F.col("n") > len(names)).join(facets, "sample_id", "left_anti")
    if flat.limit(1).count():
        raise ValueError("degenerate point set: a sample has no proper hull")
    p = [F.col(a) for a in names]

    def gap(facet: Column) -> Column:
        a, b = ([facet[i][k] for k in range(len(names))] for i in (0, 1))
        if len(names) == 2:
            return segment_distance(p, a, b)
        # every node is inside, so the nearest plane holds the nearest point
        return F.abs(sum(((c - q) * n for c, q, n in zip(p, a, b, strict=True)), F.lit(0.0)))

    ends = (0, 1) if len(names) == 2 else (0, 2, 3)  # in space a corner, then the box
    near = least_gap(nodes, facets, "facet", gap, lambda f: [[f[i][k] for k in range(len(names))] for i in ends]).withColumnRenamed("gap", HULL)
    few = nodes.join(counts.where(F.col("n") <= len(names)), "sample_id", "left_semi").select("sample_id", "node_id", F.lit(0.0).alias(HULL))
    return near.unionByName(few)


def alpha_border(nodes: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """The kept triangles (circumradius below 1/alpha) and the border edges of the alpha shape."""
    triangles = stored(delaunay_triangles(nodes), "delaunay")
    kept = triangles.where(F.col("radius") < 1.0 / alpha) if alpha > 0 else triangles
    return kept, triangle_edges(kept).where("n_triangles = 1").select("sample_id", "src", "dst")


def distance_to_alpha_shape(nodes: DataFrame, alpha: float) -> DataFrame:
    """Distance to the boundary of the alpha shape, inner rings included; alpha 0 is the convex hull.

    Warns if a shape has several parts; raises ValueError for samples with fewer than three nodes or without a shape.
    """
    nodes = as_nodes(nodes, (2,), "An alpha shape needs nodes with two coordinates (Nx2).")
    if nodes.groupBy("sample_id").count().where("count < 3").limit(1).count() or nodes.limit(1).count() == 0:
        raise ValueError("An alpha shape needs 3 points or more in every sample.")
    kept, border = alpha_border(nodes, alpha)
    border = stored(border, "alpha-border")
    if nodes.select("sample_id").distinct().join(border, "sample_id", "left_anti").limit(1).count():
        raise ValueError(f"No triangle is left at alpha={alpha}: the alpha shape of a sample is empty.")
    if _fragments(kept) > 1:
        warnings.warn(f"At alpha={alpha} the alpha shape of a sample is a MultiPolygon, in several parts.", UserWarning, stacklevel=2)
    end = lambda c, p: nodes.select("sample_id", F.col("node_id").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    edges = border.join(end("src", "a"), ["sample_id", "src"]).join(end("dst", "b"), ["sample_id", "dst"])
    edges = edges.select("sample_id", F.struct("ax", "ay", "bx", "by").alias("edge"))
    gap = lambda e: segment_distance([F.col("x"), F.col("y")], [e["ax"], e["ay"]], [e["bx"], e["by"]])
    return least_gap(nodes, edges, "edge", gap, lambda e: [[e["ax"], e["ay"]], [e["bx"], e["by"]]]).withColumnRenamed("gap", ALPHA)


def _fragments(triangles: DataFrame) -> int:
    """The most parts, joined by shared edges, that a sample's triangles have."""
    keyed = triangles.withColumn("t", F.xxhash64("sample_id", "a", "b", "c"))
    side = lambda p, q: F.struct(F.col(p).alias("src"), F.col(q).alias("dst"))
    sides = keyed.select("sample_id", "t", F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).select("sample_id", "t", "e.*")
    links = sides.groupBy("sample_id", "src", "dst").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("a", "b")
    parts = connected_components(links)
    each = keyed.select("sample_id", "t").join(parts.withColumnRenamed("node", "t"), "t", "left").withColumn("part", F.coalesce("component", "t"))
    most = each.groupBy("sample_id").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0]
    return most or 0


__all__ = [
    "distance_to_triangles",
    "distance_to_alpha_shape", "distance_to_convex_hull", "distance_to_mask", "distance_to_pointset", "distance_to_rectangular_border", "hull_facets", "mask_pixels", "with_sample",
]
