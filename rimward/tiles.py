"""Trees of square tiles, split by count, for samples of any density.

A sample's box is cut into halves along every axis, again and again, until a tile holds at most ``capacity`` nodes. Tiles of depth k have the
whole coordinates 0 to 2^k - 1; a node's tile of depth k is its finest coordinates shifted right. A *leaf* is a tile of at most ``capacity`` nodes
whose parent holds more; a tile that holds more is *inner*.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.expr import clip
from rimward.storage import stored

#: Depths that are counted at once, and the finest one.
SPAN, FINEST = 10, 30


def boxes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(sample_id, low_<axis>..., size): the lower corner and the side of each sample's box."""
    extent = F.greatest(*[F.max(a) - F.min(a) for a in names], F.lit(0.0))
    return nodes.groupBy("sample_id").agg(*[F.min(a).alias(f"low_{a}") for a in names], extent.alias("size"))


def finest(nodes: DataFrame, box: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` with their coordinates of depth FINEST, f_<axis>."""
    share = lambda a: F.coalesce(F.try_divide(F.col(a) - F.col(f"low_{a}"), F.nullif(F.col("size"), F.lit(0.0))), F.lit(0.0))
    at = lambda a: clip(F.floor(share(a) * (1 << FINEST)), F.lit(0), F.lit((1 << FINEST) - 1)).cast("long").alias(f"f_{a}")
    return nodes.join(box, "sample_id").select(*nodes.columns, *[at(a) for a in names])


def coarser(prefix: str, names: list[str], depth: Column) -> list[Column]:
    return [F.call_function("shiftright", F.col(f"f_{a}"), (F.lit(FINEST) - depth).cast("int")).alias(f"{prefix}_{a}") for a in names]


@dataclass
class Tree:
    """nodes: with depth and t_<axis>, those of their leaf. leaves, inner: (sample_id, depth, t_<axis>..., n)."""

    names: list[str]
    nodes: DataFrame
    leaves: DataFrame
    inner: DataFrame

    @property
    def key(self) -> list[str]:
        return ["sample_id", "depth", *[f"t_{a}" for a in self.names]]

    @classmethod
    def of(cls, nodes: DataFrame, names: list[str], capacity: int, whole: int = 0) -> Tree:
        """The tree over rows with f_<axis>. Nodes that the finest tiles can't part share a leaf; a sample of up to ``whole`` nodes is one."""
        key = ["sample_id", "depth", *[f"t_{a}" for a in names]]
        pending, low, counts, held = nodes, 0, [], []
        while True:
            high = min(low + SPAN - 1, FINEST)
            each = pending.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
            each = each.select(*nodes.columns, "depth", *coarser("t", names, F.col("depth")))
            counts.append(stored(each.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "tile-counts"))
            held.append(each)
            full = counts[-1].where((F.col("depth") == high) & (F.col("n") > capacity))
            if high == FINEST or full.isEmpty():
                break
            deep = pending.select(*nodes.columns, F.lit(high).alias("depth"), *coarser("t", names, F.lit(high)))
            pending = stored(deep.join(full.select(*key), key, "left_semi").select(*nodes.columns), "crowded")
            low = high + 1
        every = reduce(DataFrame.unionByName, counts)
        if whole > capacity:
            single = every.where((F.col("depth") == 0) & (F.col("n") <= whole)).select("sample_id")
            every = every.join(single, "sample_id", "left_anti").unionByName(every.where("depth = 0").join(single, "sample_id", "left_semi").withColumn("n", F.least("n", F.lit(capacity))))
        inner = every.where((F.col("n") > capacity) & (F.col("depth") < FINEST))
        small = every.where((F.col("n") <= capacity) | (F.col("depth") == FINEST))
        parents = inner.select("sample_id", (F.col("depth") + 1).alias("depth"), *[F.col(f"t_{a}").alias(f"p_{a}") for a in names])
        up = small.withColumns({f"p_{a}": F.expr(f"shiftright(t_{a}, 1)") for a in names})
        split = up.join(parents, ["sample_id", "depth", *[f"p_{a}" for a in names]], "left_semi").select(*every.columns)
        leaves = stored(split.unionByName(small.where("depth = 0")), "leaves")
        placed = reduce(DataFrame.unionByName, [e.join(leaves.select(*key), key) for e in held])
        return cls(names, stored(placed, "leaf-nodes"), leaves, stored(inner, "inner-tiles"))

    def around(self) -> DataFrame:
        """Leaves with the tiles of their own depth around them, themselves included: (key, place, u_<axis>)."""
        offsets = list(product((-1, 0, 1), repeat=len(self.names)))
        steps = F.array(*[F.struct(F.lit(i).alias("place"), *[F.lit(o).alias(a) for a, o in zip(self.names, off, strict=True)]) for i, off in enumerate(offsets)])
        near = self.leaves.select(*self.key, F.explode(steps).alias("s"))
        near = near.select(*self.key, "s.place", *[(F.col(f"t_{a}") + F.col(f"s.{a}")).alias(f"u_{a}") for a in self.names])
        side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
        return near.where(reduce(Column.__and__, [(F.col(f"u_{a}") >= 0) & (F.col(f"u_{a}") < side) for a in self.names]))

    def blocks(self, most: int = 0) -> DataFrame:
        """A row for each leaf and node of it or of the tiles around it: (b_<key> of the leaf, the node's columns, core, left_out).

        A tile around a leaf that is inner and holds more than ``most`` nodes is left out, and marked by the bit of its place in ``left_out``. So a block
        holds 3^D nodes at most for each that a leaf, or ``most`` if that is more, may hold.
        """
        mine = [F.col(k).alias(f"b_{k}") for k in self.key]
        near = stored(self.around(), "around")
        beside = self.inner.select("sample_id", "depth", *[F.col(f"t_{a}").alias(f"u_{a}") for a in self.names], "n")
        bits = F.call_function("shiftleft", F.lit(1), F.col("place"))
        beside = near.join(beside, ["sample_id", "depth", *[f"u_{a}" for a in self.names]])
        out = beside.where(F.col("n") > most).groupBy(*mine).agg(F.bit_or(bits).alias("left_out"))
        # the leaf that holds a tile, or is it, has the tile's coordinates shifted by what it is coarser
        above = near.select(*mine, "place", *[f"u_{a}" for a in self.names], F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("depth"))
        up = (F.col("b_depth") - F.col("depth")).cast("int")
        above = above.select("b_sample_id", "b_depth", *[f"b_t_{a}" for a in self.names], "place", *[f"u_{a}" for a in self.names], F.col("b_sample_id").alias("sample_id"), "depth",
                             *[F.call_function("shiftright", F.col(f"u_{a}"), up).alias(f"t_{a}") for a in self.names])
        owners = above.join(self.leaves.select(*self.key), self.key)
        if most:
            # the leaves in an inner tile have its coordinates once theirs are shifted
            below = self.leaves.where("depth > 0").select(*self.key, F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("b_depth"))
            up = (F.col("depth") - F.col("b_depth")).cast("int")
            below = below.select(*self.key, F.col("sample_id").alias("b_sample_id"), "b_depth", *[F.call_function("shiftright", F.col(f"t_{a}"), up).alias(f"u_{a}") for a in self.names])
            held = beside.where(F.col("n") <= most).select(*mine, "place", *[f"u_{a}" for a in self.names])
            owners = owners.unionByName(held.join(below, ["b_sample_id", "b_depth", *[f"u_{a}" for a in self.names]]))
        fine = {f"at_{a}": F.call_function("shiftright", F.col(f"f_{a}"), (F.lit(FINEST) - F.col("b_depth")).cast("int")) for a in self.names}
        rows = owners.join(self.nodes, self.key).withColumns(fine)
        rows = rows.where(reduce(Column.__and__, [F.col(f"at_{a}") == F.col(f"u_{a}") for a in self.names]))
        centre = (3 ** len(self.names) - 1) // 2
        rows = rows.withColumn("core", F.col("place") == centre).drop("place", "depth", *[x for a in self.names for x in (f"t_{a}", f"u_{a}", f"at_{a}")])
        keys = ["b_sample_id", "b_depth", *[f"b_t_{a}" for a in self.names]]
        return rows.join(out, keys, "left").withColumn("left_out", F.coalesce("left_out", F.lit(0)))
