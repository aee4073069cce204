"""Least distance of nodes to the pieces of a border (segments, facets, triangles), by descending two trees of cells side by side.

Nodes lie in cells of a grid, and so do pieces, by their middles; a cell knows the box of what it holds. A pair of a
node cell and a piece cell is kept while the gap between their boxes is no more than what the node cell is sure to be within.
Kept pairs go on to the cells of a finer grid until a piece cell holds few pieces; only then do nodes meet pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.expr import norm
from rimward.schema import axes
from rimward.storage import stored

#: Pieces in one array.
PACK = 256
#: Samples of this many pieces or fewer need no trees: their nodes meet all of them, packed.
DIRECT_PIECES = 1_024
#: Pieces of such samples, together, up to which they are broadcast, so that a sample's nodes stay in many tasks.
BROADCAST_PIECES = 100_000
#: Pieces of a cell that nodes meet, the level that the descent begins on, its stride, and the finest level.
LEAF, START, STRIDE, FINEST = 64, 3, 2, 23

Corners = Callable[[Column], list[list[Column]]]


def _packed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): arrays of ``PACK`` pieces or so of the same keys."""
    counted = parts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("packs"))
    return parts.join(counted, keys).groupBy(*keys, F.pmod(F.xxhash64("part"), "packs").alias("pack")).agg(F.collect_list("part").alias("parts"))


def _codes(names: list[str], level: int) -> list[Column]:
    """The cell on ``level`` of rows with cells c<axis> on the finest level."""
    return [F.shiftright(f"c{a}", FINEST - level).alias(f"c{a}") for a in names]


def final_pairs(nodes: DataFrame, pieces: DataFrame, names: list[str]) -> DataFrame:
    """(sample_id, level, a<axis>, b<axis>): node cells and the piece cells that may hold the nearest piece of one of their nodes.

    Both tables have cells of the finest level; pieces have their boxes (low_, high_) and a point on them (on_).
    """
    a_cell, b_cell = [f"a{c}" for c in names], [f"b{c}" for c in names]

    def node_cells(level: int) -> DataFrame:
        box = [f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]
        return nodes.groupBy("sample_id", *_codes(names, level)).agg(*box).select("sample_id", *[F.col(f"c{c}").alias(f"a{c}") for c in names], *[f"{m}_{c}" for m in ("min", "max") for c in names])

    def piece_cells(level: int) -> DataFrame:
        box = [F.min(f"low_{c}").alias(f"low_{c}") for c in names] + [F.max(f"high_{c}").alias(f"high_{c}") for c in names]
        on = F.min(F.struct(*[f"on_{c}" for c in names])).alias("on")
        return pieces.groupBy("sample_id", *_codes(names, level)).agg(F.count(F.lit(1)).alias("n"), on, *box).select("sample_id", *[F.col(f"c{c}").alias(f"b{c}") for c in names], "n", "on", *[f"{m}_{c}" for m in ("low", "high") for c in names])

    gap = norm([F.greatest(F.col(f"low_{c}") - F.col(f"max_{c}"), F.col(f"min_{c}") - F.col(f"high_{c}"), F.lit(0.0)) for c in names])
    sure = norm([F.greatest(F.abs(F.col(f"min_{c}") - F.col(f"on.on_{c}")), F.abs(F.col(f"max_{c}") - F.col(f"on.on_{c}"))) for c in names])

    def above(cells: list[str]) -> list[Column]:
        return [F.shiftright(c, STRIDE).alias(f"up_{c}") for c in cells]

    done: list[DataFrame] = []
    open_pairs: DataFrame | None = None
    for level in range(START, FINEST + 1, STRIDE):
        a, b = node_cells(level), piece_cells(level)
        if open_pairs is None:
            met = a.join(b, "sample_id")
        else:
            ups = {c: f"up_{c}" for c in a_cell + b_cell}
            parents = open_pairs.select("sample_id", *[F.col(c).alias(up) for c, up in ups.items()])
            met = parents.join(a.select("*", *above(a_cell)), ["sample_id", *[ups[c] for c in a_cell]])
            met = met.join(b.select("*", *above(b_cell)), ["sample_id", *[ups[c] for c in b_cell]])
        met = met.select("sample_id", *a_cell, *b_cell, "n", gap.alias("gap"), sure.alias("sure"))
        bound = met.groupBy("sample_id", *a_cell).agg(F.min("sure").alias("bound"))
        kept = met.join(bound, ["sample_id", *a_cell]).where(F.col("gap") <= F.col("bound") * (1 + 1e-9)).select("sample_id", *a_cell, *b_cell, (F.col("n") <= LEAF).alias("small"))
        kept = stored(kept, "cell-pairs")
        ends = kept if level + STRIDE > FINEST else kept.where("small")
        done.append(ends.select("sample_id", F.lit(level).alias("level"), *a_cell, *b_cell))
        open_pairs = kept.where(~F.col("small"))
        if open_pairs.limit(1).count() == 0:
            break
    return reduce(DataFrame.unionByName, done)


def least_gap(nodes: DataFrame, parts: DataFrame, part: str, gap: Callable[[Column], Column], corners: Corners) -> DataFrame:
    """(sample_id, node_id, gap): each node's least ``gap`` to the column ``part`` of its sample's rows of ``parts``.

    ``corners`` gives a piece's corners, points on it whose box holds it. Samples without parts give no rows.
    """
    names = axes(nodes)
    parts = stored(parts.select("sample_id", F.col(part).alias("part")), "pieces")
    counts = stored(parts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("pieces")), "piece-counts")
    few, many = counts.where(F.col("pieces") <= DIRECT_PIECES), counts.where(F.col("pieces") > DIRECT_PIECES)
    held = F.broadcast if (few.agg(F.sum("pieces")).first()[0] or 0) <= BROADCAST_PIECES else lambda df: df
    met = nodes.join(held(_packed(parts.join(few, "sample_id", "left_semi"), ["sample_id"])), "sample_id").select("sample_id", "node_id", *names, "parts")
    if many.limit(1).count():
        met = met.unionByName(_met(nodes.join(many, "sample_id", "left_semi"), parts.join(many, "sample_id", "left_semi"), names, corners))
    # a row to a piece, as expressions over rows are compiled and those over an array's elements aren't; tasks keep the least of a node
    each = met.select("sample_id", "node_id", *names, F.explode("parts").alias("part"))
    return each.select("sample_id", "node_id", gap(F.col("part")).alias("gap")).groupBy("sample_id", "node_id").agg(F.min("gap").alias("gap"))


def _met(nodes: DataFrame, parts: DataFrame, names: list[str], corners: Corners) -> DataFrame:
    """(sample_id, node_id, axes, parts): nodes with the packs of pieces in the cells left to them."""
    at = corners(F.col("part"))
    boxed = parts.select(
        "sample_id", "part", *[F.least(*[c[i] for c in at]).alias(f"low_{a}") for i, a in enumerate(names)],
        *[F.greatest(*[c[i] for c in at]).alias(f"high_{a}") for i, a in enumerate(names)], *[at[0][i].alias(f"on_{a}") for i, a in enumerate(names)],
    )
    ends = boxed.select("sample_id", *[F.col(f"low_{a}").alias(a) for a in names]).unionByName(boxed.select("sample_id", *[F.col(f"high_{a}").alias(a) for a in names])).unionByName(nodes.select("sample_id", *names))
    extent = F.greatest(*[F.max(a) - F.min(a) for a in names])
    box = stored(ends.groupBy("sample_id").agg(*[F.min(a).alias(f"from_{a}") for a in names], F.when(extent > 0, extent).otherwise(1.0).alias("extent")), "piece-boxes")

    def celled(df: DataFrame, value: Callable[[str], Column]) -> DataFrame:
        most = (1 << FINEST) - 1
        cell = [F.least(F.floor((value(a) - F.col(f"from_{a}")) / F.col("extent") * float(1 << FINEST)), F.lit(most)).alias(f"c{a}") for a in names]
        return stored(df.join(box, "sample_id").select(*df.columns, *cell), "celled")

    nodes = celled(nodes.select("sample_id", "node_id", *names), F.col)
    pieces = celled(boxed, lambda a: (F.col(f"low_{a}") + F.col(f"high_{a}")) / 2)
    pairs = stored(final_pairs(nodes, pieces, names), "final-pairs")
    levels = [r["level"] for r in pairs.select("level").distinct().collect()]  # at most (FINEST - START) / STRIDE + 1

    def on_levels(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
        each = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        return each.select("sample_id", *keep, "level", *[F.expr(f"shiftright(c{a}, {FINEST} - level)").alias(f"{prefix}{a}") for a in names])

    a_cell, b_cell = [f"a{c}" for c in names], [f"b{c}" for c in names]
    asked = pairs.select("sample_id", "level", *b_cell).distinct()
    packs = _packed(on_levels(pieces, ["part"], "b").join(asked, ["sample_id", "level", *b_cell], "left_semi"), ["sample_id", "level", *b_cell])
    near = on_levels(nodes, ["node_id", *names], "a").join(pairs, ["sample_id", "level", *a_cell])
    return near.join(packs, ["sample_id", "level", *b_cell]).select("sample_id", "node_id", *names, "parts")
