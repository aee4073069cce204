"""Exact Delaunay triangles and tetrahedra of samples of any size and density.

Nodes are dealt to the leaves of a tree of tiles (:mod:`rimward.tiles`). A task takes the simplices at a leaf's nodes among those of the tiles around it. A simplex whose
circumsphere, as far as it lies in the sample's box, is inside that block is final: no other node can be in it. Nodes of the
leaf with an uncertain simplex, or on the block's hull, are *open*. Any missing simplex has open corners alone, and is a simplex of the open nodes too.
So the open nodes are dealt to a tree of their own, whose tiles are larger as the open nodes are fewer; of the simplices that are certain there, those whose spheres hold
no node at all are final. That is repeated until a block holds all that are left. Where half of the nodes or more stay open, as on a circle, leaves take
four times as many. Spheres that hold a node of the leaf at their centre fall first. The others are held against the tree of all nodes from its root down, and one that holds a whole tile falls at once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.expr import clip
from rimward.geometry import tetrahedralise, triangulate
from rimward.schema import axes
from rimward.storage import stored
from rimward.tiles import FINEST, Tree, boxes, coarser, finest

#: Nodes of a leaf, by dimension, and how many times as many a tile beside one may hold before it is left out.
TILE_POINTS, CROWD = {2: 256, 3: 96}, 8
SCHEMA = "sample_id string, corners array<long>, centre array<double>, radius double"
#: Rounding of spheres and sides, as a share of the box.
SLACK = 1e-9
#: Depths that a sphere goes down at a time.
HOPS = 4
#: Blocks of a task, and how many tasks there are at least, where blocks suffice, and at most.
TASK_BLOCKS, FEW_TASKS, MOST_TASKS = 64, 32, 2_000


def _block_of(names: list[str]):
    """The task of a block: final simplices, and the core's open nodes as rows without centre."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sample, depth, *tile = key
        rows = rows.sort_values("node_id")
        points, ids, core = rows[names].to_numpy(), rows["node_id"].to_numpy(), rows["core"].to_numpy()
        corners, centres, radii = (triangulate if len(names) == 2 else tetrahedralise)(points, ids, None if core.all() else core)
        low, size, left_out = rows[[f"low_{a}" for a in names]].iloc[0].to_numpy(float), float(rows["size"].iloc[0]), int(rows["left_out"].iloc[0])
        side, at = size / 2.0**depth, np.array(tile)
        first = np.where(at <= 1, -np.inf, low + (at - 1) * side)
        last = np.where(at >= 2**depth - 2, np.inf, low + (at + 2) * side)
        whole = not left_out and np.isinf(first).all() and np.isinf(last).all()
        sure, unsure = np.ones(len(corners), dtype=bool), np.zeros(len(points), dtype=bool)
        if not whole:
            unsure[:] = True
        if len(corners) and not whole:
            reach = radii[:, None] + SLACK * size
            sure = ((centres - reach > first) & (centres + reach < last)).all(axis=1)
            for place, step in enumerate(product((-1, 0, 1), repeat=len(names))):
                if left_out >> place & 1:
                    start = low + (at + np.array(step)) * side
                    gap = np.maximum(np.maximum(start - centres, centres - start - side), 0.0)
                    sure &= (gap**2).sum(axis=1) > (reach[:, 0]) ** 2
            unsure[:] = False
            unsure[corners[~sure].ravel()] = True
            faces = np.sort(np.concatenate([corners[:, list(c)] for c in combinations(range(len(names) + 1), len(names))]), axis=1)
            named, times = np.unique(faces, axis=0, return_counts=True)
            unsure[named[times == 1].ravel()] = True
            seen = np.zeros(len(points), dtype=bool)
            seen[corners.ravel()] = True
            unsure |= ~seen
        mine = np.flatnonzero(sure & core[corners].any(axis=1)) if len(corners) else np.zeros(0, int)
        held = [sorted(ids[corners[i]].tolist()) for i in mine] + [[int(i)] for i in ids[core & unsure]]
        opened = len(held) - len(mine)
        return pd.DataFrame({
            "sample_id": sample, "corners": pd.Series(held, dtype=object), "centre": pd.Series([*centres[mine].tolist(), *[None] * opened], dtype=object), "radius": np.concatenate([radii[mine], np.full(opened, np.nan)])
        })

    return run


def _pierced(simplices: DataFrame, tree: Tree, box: DataFrame) -> DataFrame:
    """(sample_id, corners) of the simplices whose spheres hold a node of the leaf that their centre, drawn into the box, lies in."""
    names, key = tree.names, ["sample_id", "corners"]
    deepest = tree.leaves.agg(F.max("depth")).first()[0]
    centres = simplices.join(box, "sample_id").select(*key, "radius", *[F.col("centre")[i].alias(f"c_{a}") for i, a in enumerate(names)], *[f"low_{a}" for a in names], "size")
    share = lambda a: F.coalesce(F.try_divide(F.col(f"c_{a}") - F.col(f"low_{a}"), F.col("size")), F.lit(0.0))
    fine = [F.least(F.floor(clip(share(a), F.lit(0.0), F.lit(1.0)) * (1 << FINEST)), F.lit((1 << FINEST) - 1)).alias(f"f_{a}") for a in names]
    at = centres.select(*key, "radius", *[f"c_{a}" for a in names], *fine, F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    at = at.select(*key, "radius", *[f"c_{a}" for a in names], "depth", *coarser("t", names, F.col("depth"))).join(tree.leaves.select(*tree.key), tree.key)
    away = reduce(Column.__add__, [(F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in names])
    met = at.join(tree.nodes.select(*tree.key, "node_id", *names), tree.key).where(away < F.col("radius") * F.col("radius") * (1 - SLACK))
    return met.where(~F.array_contains("corners", F.col("node_id"))).select(*key).distinct()


def _certain(simplices: DataFrame, tree: Tree, box: DataFrame, left: DataFrame) -> DataFrame:
    """The simplices whose spheres hold no node of the tree; where nodes lie on a sphere beside those in ``left``, the simplices of all the sphere's nodes."""
    names, key = tree.names, ["sample_id", "corners"]
    # most spheres that aren't empty hold a node near their centre, and needn't be held against the tree
    simplices = stored(simplices.join(_pierced(simplices, tree, box), key, "left_anti"), "empty-centres")
    square = F.col("radius") * F.col("radius")
    tiles = tree.leaves.select(*tree.key, F.lit(True).alias("leaf")).unionByName(tree.inner.select(*tree.key, F.lit(False).alias("leaf")))

    def gaps(far: bool) -> Column:
        """The square of the distance from the centre to the nearest, or the furthest, point of the tile."""
        total = F.lit(0.0)
        for i, a in enumerate(names):
            side = F.col("size") / F.pow(F.lit(2.0), "depth")
            start, centre = F.col(f"low_{a}") + F.col(f"t_{a}") * side, F.col("centre")[i]
            one = F.greatest(F.abs(start - centre), F.abs(start + side - centre)) if far else F.greatest(start - centre, centre - start - side, F.lit(0.0))
            total = total + one * one
        return total

    def stepped(rows: DataFrame) -> DataFrame:
        """Rows at inner tiles that reach out of the sphere go to the halves that the sphere meets; the others stay."""
        goes = ~F.col("leaf") & ~F.col("swallowed")
        down = [F.struct((F.col("depth") + 1).alias("depth"), *[(2 * F.col(f"t_{a}") + bit).alias(f"t_{a}") for a, bit in zip(names, bits, strict=True)]) for bits in product((0, 1), repeat=len(names))]
        here = F.struct(F.col("depth").alias("depth"), *[F.col(f"t_{a}").alias(f"t_{a}") for a in names])
        moved = rows.withColumn("tile", F.explode(F.when(goes, F.array(*down)).otherwise(F.array(here)))).drop("leaf", "swallowed", "depth", *[f"t_{a}" for a in names])
        return met(moved.select("*", "tile.*").drop("tile").where(gaps(far=False) <= square * (1 + SLACK)))

    def met(rows: DataFrame) -> DataFrame:
        return rows.join(tiles, tree.key).withColumn("swallowed", gaps(far=True) < square * (1 - SLACK))

    start = simplices.join(box, "sample_id").withColumns({"depth": F.lit(0)} | {f"t_{a}": F.lit(0).cast("long") for a in names})
    rows, fallen, reached = met(start), [], []
    while True:
        for _ in range(HOPS):
            rows = stepped(rows)
        rows = stored(rows, "sphere-tiles")
        fallen.append(rows.where("swallowed").select(*key).distinct())
        rows = rows.join(fallen[-1], key, "left_anti")
        reached.append(rows.where("leaf"))
        rows = rows.where(~F.col("leaf"))
        if rows.isEmpty():
            break
    leaves = reduce(DataFrame.unionByName, reached).select(*key, "centre", "radius", *tree.key[1:])
    near = leaves.join(tree.nodes.select(*tree.key, "node_id", *names), tree.key).where(~F.array_contains("corners", F.col("node_id")))
    away = reduce(Column.__add__, [(F.col(a) - F.col("centre")[i]) * (F.col(a) - F.col("centre")[i]) for i, a in enumerate(names)])
    near = stored(near.withColumn("away", away).where(F.col("away") <= square * (1 + SLACK)).select(*key, "node_id", *names, (F.col("away") < square * (1 - SLACK)).alias("inside")).distinct(), "sphere-nodes")
    empty = simplices
    for hit in (*fallen, near.where("inside").select(*key).distinct()):
        empty = empty.join(hit, key, "left_anti")
    on = near.where(~F.col("inside")).join(left.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_anti").select(*key, "node_id", *names)
    if on.isEmpty():
        return empty
    # nodes that were final before lie on the sphere: the sphere's cell is taken anew from all of its nodes
    tied = stored(on.select(*key).distinct().join(empty, key, "left_semi"), "tied")
    held = tied.select(*key, F.explode("corners").alias("node_id")).join(tree.nodes.select("sample_id", "node_id", *names), ["sample_id", "node_id"])
    cells = held.select(*key, "node_id", *names).unionByName(near.join(tied, key, "left_semi").select(*key, "node_id", *names))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["node_id"].to_numpy()
        made, _, _ = (triangulate if len(names) == 2 else tetrahedralise)(rows[names].to_numpy(), ids)
        right = sorted(key[1]) in np.sort(ids[made], axis=1).tolist()
        return pd.DataFrame({"sample_id": [key[0]] * (not right), "corners": pd.Series([list(key[1])] * (not right), dtype=object)})

    wrong = cells.groupBy(*key).applyInPandas(judge, "sample_id string, corners array<long>")
    return empty.join(wrong, key, "left_anti")


def delaunay_simplices(nodes: DataFrame, capacity: int | None = None) -> DataFrame:
    """(sample_id, corners, centre, radius) with corners in order of id: triangles in the plane, tetrahedra in space. Of coincident nodes the smallest id counts."""
    names = axes(nodes)
    held = capacity or TILE_POINTS[len(names)]
    whole = held * 3 ** len(names) if capacity is None else capacity  # what any block may hold
    distinct = stored(nodes.groupBy("sample_id", *names).agg(F.min("node_id").alias("node_id")), "distinct-nodes")
    counts = distinct.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    small, large = counts.where(F.col("n") <= whole), stored(counts.where(F.col("n") > whole), "large-samples")
    run = _block_of(names)
    # a sample of no more nodes than a block holds is one
    alone = distinct.join(small, "sample_id").select("sample_id", "node_id", *names, F.lit(True).alias("core"), F.lit(1.0).alias("size"), F.lit(0).alias("left_out"), *[F.lit(0.0).alias(f"low_{a}") for a in names])
    one = (0,) * (1 + len(names))
    final = [alone.groupBy("sample_id").applyInPandas(lambda key, rows: run((key[0], *one), rows), SCHEMA)]
    if large.isEmpty():
        return final[0]
    rest = distinct.join(large, "sample_id", "left_semi")
    box = stored(boxes(rest, names), "boxes")
    left = stored(finest(rest, box, names), "open-nodes")
    n_left, every = left.count(), None
    while n_left:
        tree = Tree.of(left, names, held, whole)
        every = every or tree
        keys, blocks = ["b_sample_id", "b_depth", *[f"b_t_{a}" for a in names]], tree.leaves.count()
        tasks = min(3 * blocks, max(FEW_TASKS, blocks // TASK_BLOCKS), MOST_TASKS)
        task = tree.blocks(CROWD * held).join(box, "sample_id").repartition(tasks, *keys).groupBy(*keys)
        found = stored(task.applyInPandas(run, SCHEMA), "simplices")
        sure = found.where("centre IS NOT NULL").dropDuplicates(["sample_id", "corners"])
        if tree is not every:
            for earlier in final[1:]:
                sure = sure.join(earlier.select("sample_id", "corners"), ["sample_id", "corners"], "left_anti")
            sure = _certain(stored(sure, "likely-simplices"), every, box, left)
        final.append(stored(sure, "final-simplices"))
        opened = found.where("centre IS NULL").select("sample_id", F.col("corners")[0].alias("node_id")).distinct()
        left = stored(left.join(opened, ["sample_id", "node_id"], "left_semi"), "open-nodes")
        before, n_left = n_left, left.count()
        if 2 * n_left > before:
            held, whole = 4 * held, 4 * whole
    return reduce(DataFrame.unionByName, final)


def delaunay_triangles(nodes: DataFrame) -> DataFrame:
    """(sample_id, a, b, c, radius) with a < b < c, of nodes in the plane."""
    return delaunay_simplices(nodes).select("sample_id", *[F.col("corners")[i].alias(c) for i, c in enumerate("abc")], "radius")


def simplex_edges(simplices: DataFrame) -> DataFrame:
    """(sample_id, src, dst) with src < dst: the edges of simplices."""
    n = F.size("corners")
    later = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(F.get("corners", i).alias("src"), F.get("corners", j).alias("dst")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), later))
    return simplices.select("sample_id", F.explode(pairs).alias("e")).select("sample_id", "e.*").distinct()


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """(sample_id, src, dst, n_triangles): edges with src < dst; those of one triangle are the border."""
    side = lambda p, q: F.struct(F.col(p).alias("src"), F.col(q).alias("dst"))
    rows = triangles.select("sample_id", F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).select("sample_id", "e.*")
    return rows.groupBy("sample_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_triangles"))
