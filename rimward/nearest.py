"""Exact k nearest points in the plane or in space, by grids of many levels, so that dense and sparse places each have a fitting one.

Cells of level 0 are small; a cell of the next level is twice as wide. A query begins on the level on which its own cell
first holds more than k points, and looks at the 3^D cells around its own. No point outside them is nearer than a cell's width, so it is done once
its k-th distance is within that; the others go on a level higher. A query that isn't done has few
points near it, so there are few of them to a cell, and clusters make no more pairs than even clouds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.expr import clip, norm
from rimward.schema import axes
from rimward.storage import dropped, stored

#: Points of all samples up to this many are compared directly, without a grid.
DIRECT_ROWS = 1_000
#: Levels below the one on which an even cloud has a point or so to a cell, and most levels of a grid.
FINER, MOST_LEVELS = 4, 40


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("sample_id", "node_id").orderBy("distance", "point_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_points(queries: DataFrame, points: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
    """(sample_id, node_id, point_id, distance, rank): the k points nearest to each query of its sample; ties go to the smaller id.

    Points without a sample_id are those of every sample, on one grid.
    """
    names = axes(queries)
    of = [c for c in ("sample_id",) if c in points.columns]
    target = points.select(*of, F.col("node_id").alias("point_id"), *[F.col(a).alias(f"p{a}") for a in names])
    out = ("sample_id", "node_id", "point_id", "distance", "rank")

    def paired(some: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        both = some.join(other, on) if on else some.crossJoin(F.broadcast(other))  # DIRECT_ROWS points at most
        if exclude_same_id:
            both = both.where("node_id <> point_id")
        return both.withColumn("distance", norm([F.col(a) - F.col(f"p{a}") for a in names]))

    if points.count() <= DIRECT_ROWS:
        return _ranked(paired(queries, target, of), k).select(*out)
    extent = F.greatest(*[F.max(a) - F.min(a) for a in names], F.lit(0.0))
    box = points.groupBy(*of).agg(
        F.count(F.lit(1)).alias("n"), extent.alias("extent"), *[F.min(a).alias(f"low_{a}") for a in names], *[F.max(a).alias(f"high_{a}") for a in names]
    )
    even = F.ceil(F.log2(F.greatest(F.pow(F.col("n") / (k + 1.0), F.lit(1.0 / len(names))), F.lit(1.0))))
    box = box.withColumn("top", F.least(even + FINER, F.lit(MOST_LEVELS)).cast("int")).withColumn("size", F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0) / F.pow(F.lit(2.0), "top"))
    cells = [f"c{a}" for a in names]

    def dealt(df: DataFrame, prefix: str = "") -> DataFrame:
        """``df`` with its cells of level 0; what lies outside the box is dealt as its projection on the box, ``off`` away."""
        joined = df.join(box, of) if of else df.crossJoin(F.broadcast(box))  # one row
        near = {a: clip(F.col(prefix + a), F.col(f"low_{a}"), F.col(f"high_{a}")) for a in names}
        cell = [F.least(F.floor((near[a] - F.col(f"low_{a}")) / F.col("size")), F.pow(F.lit(2.0), "top").cast("long") - 1).alias(f"c{a}") for a in names]
        off = norm([F.col(prefix + a) - near[a] for a in names])
        return joined.select(*df.columns, "top", "size", off.alias("off"), *cell)

    at = lambda level: [F.expr(f"shiftright({c}, {level})").alias(c) for c in cells]
    held = stored(dealt(target, "p").drop("size", "off"), "cells")
    every = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    counts = held.select(*of, *cells, every).select(*of, "level", *at("level")).groupBy(*of, "level", *cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    asked = dealt(queries)
    begins = asked.select("sample_id", "node_id", *cells, every).select("sample_id", "node_id", "level", *at("level")).join(counts, [*of, "level", *cells])
    begins = begins.groupBy("sample_id", "node_id").agg(F.min("level").alias("level"))
    left = stored(asked.join(begins, ["sample_id", "node_id"], "left").withColumn("level", F.coalesce("level", "top")), "queries")
    done: list[DataFrame] = []
    while levels := [r["level"] for r in left.select("level").distinct().collect()]:  # MOST_LEVELS at most
        spread = left.select("sample_id", "node_id", *names, "level", *at("level"))
        for c in cells:
            spread = spread.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        here = held.select(*of, "point_id", *[f"p{a}" for a in names], *cells, F.explode(F.array(*map(F.lit, levels))).alias("level")).select(*of, "point_id", *[f"p{a}" for a in names], "level", *at("level"))
        found = stored(_ranked(paired(spread, here, [*of, "level", *cells]), k).select(*out), "near")
        last = found.where(F.col("rank") == k).select("sample_id", "node_id", F.col("distance").alias("furthest"))
        width = F.col("size") * F.pow(F.lit(2.0), "level")
        judged = left.join(last, ["sample_id", "node_id"], "left")
        judged = judged.withColumn("ends", (F.col("level") >= F.col("top")) | F.coalesce(F.col("furthest") * F.col("furthest") <= (F.col("off") * F.col("off") + width * width) * (1 - 1e-12), F.lit(False)))
        judged = stored(judged, "judged")
        done.append(found.join(judged.where("ends").select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi"))
        left = stored(judged.where(~F.col("ends")).drop("furthest", "ends").withColumn("level", F.col("level") + 1), "queries", replaces=left)
    dropped(left)
    return reduce(DataFrame.unionByName, done)
