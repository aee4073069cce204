"""Centralities of the nodes of undirected, unweighted graphs, per sample.

Every measure gives (sample_id, node_id, <measure>) for every node; nodes without edges included. Closeness and
harmonic share one search from all nodes, with a bit to a source; betweenness counts paths from batches of sources.
Samples of up to ``PACKED_EDGES`` directed edges travel packed, each to many tasks, and a task searches from its share of the
sources; sources whose bits lie side by side are near one another, so at each level only the nodes that they come to are touched. Larger ones are searched by joins, whose levels are written to the shared folder and deleted once passed.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.blocks import EdgeBlocks
from rimward.schema import as_nodes, with_sample
from rimward.storage import dropped, stored

MEASURES = ("degree", "pagerank", "betweenness", "closeness", "harmonic", "clustering")
#: Measures that take blocks of edges as they are.
OF_BLOCKS = ("degree", "clustering")
DAMPING, TOLERANCE, MOST_ROUNDS = 0.85, 1e-6, 100
#: Samples up to which the driver notes which of them have converged; beyond it a table does.
FEW_SAMPLES = 1_000
#: Nodes of a block of neighbour bits (32 MB at most); what a wedge's row costs, in words of bits; tables of nodes up to so many rows are broadcast.
BITS_SIDE, WEDGE_WORDS, BROADCAST_NODES = 16_384, 50, 500_000
#: Sources of a sample that are searched from at once, by bits and with counted paths.
WORD_SOURCES, PATH_SOURCES = 8_192, 4_096
#: Directed edges up to which a sample's graph is packed (12 bytes an edge at most).
PACKED_EDGES = 4_000_000
#: Sources times edges of a task, how many times as many by bits, and how many tasks there are at most at a time.
TASK_WORK, BITS_SHARE, MOST_TASKS = 200_000_000, 3, 2_000
#: Words of a node that are searched at once, how many of all nodes a task holds, and sources times nodes that it holds with counted paths.
HELD_WORDS, HELD_BITS, HELD_PATHS = 8, 8_000_000, 500_000
#: Nodes that must have a k-th neighbour for k-th neighbours to be gathered at once.
FEW_HUBS = 64


@dataclass
class Graph:
    """Nodes with their sample's size, distinct undirected edges without loops, both directions of them, and loops; or the nodes and blocks of edges."""

    nodes: DataFrame
    edges: DataFrame | None = None
    both: DataFrame | None = None
    loops: DataFrame | None = None
    blocks: EdgeBlocks | None = None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame | EdgeBlocks) -> Graph:
        ids = nodes.select("sample_id", "node_id").distinct()
        sizes = ids.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
        if isinstance(edges, EdgeBlocks):
            if edges.places.join(ids, ["sample_id", "node_id"], "left_anti").limit(1).count():
                raise ValueError("The edge list holds ids that aren't nodes.")
            return cls(ids.join(sizes, "sample_id"), blocks=edges)
        rows = with_sample(edges).select("sample_id", F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()
        rows = stored(rows, "edges")
        ends = rows.select("sample_id", F.explode(F.array("src", "dst")).alias("node_id"))
        if ends.join(ids, ["sample_id", "node_id"], "left_anti").limit(1).count():
            raise ValueError("The edge list holds ids that aren't nodes.")
        plain = rows.where("src <> dst")
        both = plain.unionByName(plain.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        return cls(ids.join(sizes, "sample_id"), plain, stored(both, "both-ways"), rows.where("src = dst"))

    def of_samples(self, some: DataFrame) -> Graph:
        """The part of the graph in the samples of ``some`` (sample_id)."""
        return Graph(*[part.join(some, "sample_id", "left_semi") for part in (self.nodes, self.edges, self.both, self.loops)])

    def filled(self, scores: DataFrame, name: str) -> DataFrame:
        rows = self.nodes.join(scores, ["sample_id", "node_id"], "left")
        return rows.select("sample_id", "node_id", F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name))


def degree(g: Graph) -> DataFrame:
    """Neighbours of a node; a loop counts twice."""
    if g.blocks is not None:
        return g.filled(g.blocks.degree().withColumnRenamed("k", "degree"), "degree")
    ends = g.both.select("sample_id", F.col("src").alias("node_id"), F.lit(1).alias("k")).unionByName(g.loops.select("sample_id", F.col("src").alias("node_id"), F.lit(2).alias("k")))
    return g.filled(ends.groupBy("sample_id", "node_id").agg(F.sum("k").alias("degree")), "degree")


def _bits_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The neighbours (place, others) of the nodes of one part in another, as rows of bits."""
    places = rows["place"].to_numpy()
    bits = np.zeros((places.max() + 1, (int(rows["width"].iloc[0]) + 63) // 64 * 64), np.uint8)
    for place, others in zip(places, rows["others"], strict=True):
        bits[place, np.asarray(others)] = 1
    return rows[["sample_id", "part", "other"]].iloc[:1].assign(bits=[np.packbits(bits, axis=1).tobytes()], words=bits.shape[1] // 64)


def _bits_met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For parts i and j of nodes, how many neighbours in one part a node of i shares with its neighbours of j, and these with it."""
    for frame in frames:
        for row in frame.itertuples():
            x, y = (np.frombuffer(b, np.uint64).reshape(-1, row.words) for b in (row.x, row.y))
            edges = np.frombuffer(row.z, np.uint8).reshape(-1, row.z_words * 8)
            sums = {row.i: np.zeros(len(edges), np.int64), row.j: np.zeros(max(len(edges), row.z_words * 64), np.int64)}
            for place in range(min(len(edges), len(x))):
                near = np.flatnonzero(np.unpackbits(edges[place]))
                near = near[near < len(y)]
                shared = np.bitwise_count(y[near] & x[place]).sum(axis=1, dtype=np.int64)
                sums[row.i][place] += shared.sum()
                if row.i < row.j:
                    sums[row.j][near] += shared
            for part, shared in sums.items():
                place = np.flatnonzero(shared)
                yield pd.DataFrame({"sample_id": row.sample_id, "part": part, "place": place, "shared": shared[place]})


def _triangles_by_bits(g: Graph, held: Callable) -> DataFrame:
    """(sample_id, node_id, t): triangles at a node, which are half of the neighbours that it shares with each of its neighbours, summed.

    Nodes are dealt to parts of some ``BITS_SIDE``; a block holds the neighbours that one part's nodes have in another, a bit each.
    """
    part = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / BITS_SIDE)).cast("int")
    place = F.row_number().over(Window.partitionBy("sample_id", "part").orderBy("node_id")) - 1
    places = stored(g.nodes.select("sample_id", "node_id", part.alias("part")).withColumn("place", place), "places")
    widths = places.groupBy("sample_id", F.col("part").alias("other")).agg((F.max("place") + 1).alias("width"))
    at = lambda end, part, place: held(places.select("sample_id", F.col("node_id").alias(end), F.col("part").alias(part), F.col("place").alias(place)))
    rows = g.both.join(at("src", "part", "place"), ["sample_id", "src"]).join(at("dst", "other", "neighbour"), ["sample_id", "dst"])
    rows = rows.groupBy("sample_id", "part", "place", "other").agg(F.collect_list("neighbour").alias("others")).join(widths, ["sample_id", "other"])
    blocks = stored(rows.groupBy("sample_id", "part", "other").applyInPandas(_bits_of, "sample_id string, part int, other int, bits binary, words int"), "neighbour-bits")
    of = lambda part, other, bits, words: blocks.select("sample_id", F.col("part").alias(part), F.col("other").alias(other), F.col("bits").alias(bits), F.col("words").alias(words))
    # blocks are few and large, so they meet as rows of three in a shuffle of their own
    n = blocks.count()
    met = of("i", "k", "x", "words").join(of("j", "k", "y", "y_words").drop("y_words"), ["sample_id", "k"]).where("i <= j").join(of("i", "j", "z", "z_words"), ["sample_id", "i", "j"])
    shared = met.repartition(min(max(n, 1), MOST_TASKS)).select("sample_id", "i", "j", "x", "y", "z", "words", "z_words").mapInPandas(_bits_met, "sample_id string, part int, place int, shared long")
    sums = shared.groupBy("sample_id", "part", "place").agg((F.sum("shared") / 2).cast("long").alias("t"))
    return sums.join(places, ["sample_id", "part", "place"]).select("sample_id", "node_id", "t")


def clustering(g: Graph) -> DataFrame:
    """Triangles at a node over pairs of its neighbours; edges point from lower to higher degree, so hubs make few wedges.

    In samples in which even so an edge has more wedges than its ends have words of neighbour bits, by cost, bits are compared and no wedge is written.
    Blocks of edges are compared as they are.
    """
    if g.blocks is not None:
        return _share_of_pairs(g, g.blocks.triangles(), g.blocks.degree())
    k = g.both.groupBy("sample_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    held = F.broadcast if g.nodes.count() <= BROADCAST_NODES else lambda df: df
    end = lambda c: held(k.select("sample_id", F.col("node_id").alias(c), F.col("k").alias(f"k_{c}")))
    ranked = g.edges.join(end("src"), ["sample_id", "src"]).join(end("dst"), ["sample_id", "dst"])
    up = (F.col("k_src") < F.col("k_dst")) | ((F.col("k_src") == F.col("k_dst")) & (F.col("src") < F.col("dst")))
    ahead = ranked.select("sample_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    fans = ahead.groupBy("sample_id", "a").agg(F.count(F.lit(1)).alias("d")).groupBy("sample_id").agg(F.sum("d").alias("m"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("wedges"))
    sizes = g.nodes.groupBy("sample_id").agg(F.first("n").alias("n"))
    dense = stored(fans.join(sizes, "sample_id").where(F.col("wedges") * WEDGE_WORDS > F.col("m") * F.ceil(F.col("n") / 64)).select("sample_id"), "dense-samples")
    sparse = g.edges.join(dense, "sample_id", "left_anti")
    ahead = stored(ahead.join(dense, "sample_id", "left_anti"), "oriented")
    wedges = ahead.alias("p").join(ahead.alias("q"), (F.col("p.sample_id") == F.col("q.sample_id")) & (F.col("p.a") == F.col("q.a")) & (F.col("p.b") < F.col("q.b")))
    wedges = wedges.select("p.sample_id", "p.a", F.col("p.b").alias("src"), F.col("q.b").alias("dst"))
    triangles = wedges.join(sparse, ["sample_id", "src", "dst"])
    corners = triangles.select("sample_id", F.explode(F.array("a", "src", "dst")).alias("node_id")).groupBy("sample_id", "node_id").agg(F.count(F.lit(1)).alias("t"))
    if not dense.isEmpty():
        corners = corners.unionByName(_triangles_by_bits(g.of_samples(dense), held))
    return _share_of_pairs(g, corners, k)


def _share_of_pairs(g: Graph, triangles: DataFrame, k: DataFrame) -> DataFrame:
    share = 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1))
    return g.filled(triangles.where("t > 0").join(k, ["sample_id", "node_id"]).select("sample_id", "node_id", share.alias("clustering")), "clustering")


def pagerank(g: Graph) -> DataFrame:
    """Power iteration; stops in each sample when the ranks' total change is below n * 1e-6, and fails after 100 rounds."""
    out = g.both.unionByName(g.loops).groupBy("sample_id", "src").agg(F.count(F.lit(1)).alias("out"))
    links = stored(g.both.unionByName(g.loops).join(out, ["sample_id", "src"]).select("sample_id", "src", "dst", (1.0 / F.col("out")).alias("share")), "links")
    dangling = out.select("sample_id", F.col("src").alias("node_id"), F.lit(True).alias("has_out"))
    ranks = stored(
        g.nodes.join(dangling, ["sample_id", "node_id"], "left").select("sample_id", "node_id", "n", F.coalesce("has_out", F.lit(False)).alias("has_out"), (1.0 / F.col("n")).alias("rank"), F.lit(False).alias("done"), F.lit(0.0).alias("before")), "ranks"
    )
    few = g.nodes.select("sample_id").distinct().count() <= FEW_SAMPLES
    for _ in range(MOST_ROUNDS):
        moving = ranks.where(~F.col("done"))
        got = moving.join(links.withColumnRenamed("src", "node_id"), ["sample_id", "node_id"]).groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = moving.groupBy("sample_id").agg(F.sum(F.when(F.col("has_out"), 0.0).otherwise(F.col("rank"))).alias("loose"))
        new = DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n")) + (1 - DAMPING) / F.col("n")
        step = moving.join(got, ["sample_id", "node_id"], "left").join(loose, "sample_id").select("sample_id", "node_id", "n", "has_out", new.alias("rank"), F.lit(False).alias("done"), F.col("rank").alias("before"))
        # samples that are done keep their rows; the change is summed from the table that the next round reads
        ranks = stored(ranks.where("done").unionByName(step), "ranks", replaces=ranks)
        change = ranks.where(~F.col("done")).groupBy("sample_id").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("moved"), F.first("n").alias("n"))
        still = {r["sample_id"]: r["moved"] >= r["n"] * TOLERANCE for r in change.collect()} if few else None
        if still is None:
            rested = change.where(F.col("moved") < F.col("n") * TOLERANCE).select("sample_id", F.lit(True).alias("rests"))
            marked = ranks.join(rested, "sample_id", "left").withColumn("done", F.col("done") | F.coalesce("rests", F.lit(False)))
            ranks = stored(marked.select(*ranks.columns), "ranks", replaces=ranks)
            over = ranks.where(~F.col("done")).isEmpty()
        else:
            over = not any(still.values())
            path = ranks._rimward_path
            ranks = ranks.withColumn("done", F.col("done") | F.col("sample_id").isin([s for s, moves in still.items() if not moves]))
            ranks._rimward_path = path
        if over:
            return ranks.select("sample_id", "node_id", F.col("rank").alias("pagerank"))
    raise ArithmeticError(f"pagerank hasn't converged in {MOST_ROUNDS} rounds")


def _batches(g: Graph, size: int) -> tuple[DataFrame, int]:
    """(sample_id, node_id, batch, place) of all nodes, and the number of batches: some ``size`` nodes of each sample to a batch, numbered within it."""
    of = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / size))
    place = F.row_number().over(Window.partitionBy("sample_id", "batch").orderBy("node_id")) - 1
    most = g.nodes.agg(F.max(F.ceil(F.col("n") / size))).first()[0] or 0
    return stored(g.nodes.select("sample_id", "node_id", of.alias("batch")).withColumn("place", place), "sources"), most


def _neighbours(begins: np.ndarray, ends: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The neighbours of ``nodes``, one node's behind the other's."""
    k = begins[nodes + 1] - begins[nodes]
    return ends[np.arange(k.sum()) + np.repeat(begins[nodes] - (np.cumsum(k) - k), k)]


def _near_order(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All nodes, so that those in a row are near one another: distances from three far nodes serve as coordinates, and are halved in turn."""
    n, near = len(begins) - 1, 64 * HELD_WORDS
    at, placed, out = np.full((3, n), -1, np.int32), np.zeros(n, dtype=bool), []

    def walk(start: int, depth: np.ndarray) -> np.ndarray:
        front = np.array([start])
        depth[start], met = 0, [front]
        while len(front):
            to = _neighbours(begins, ends, front)
            to = to[depth[to] < 0]
            depth[to] = len(met)
            front = np.unique(to)
            met.append(front)
        return np.concatenate(met)

    for start in range(n):
        if placed[start]:
            continue
        part = walk(start, at[0])
        placed[part] = True
        if len(part) > near:
            at[0, part] = -1
            walk(part[-1], at[0])
            walk(part[np.argmax(at[0, part])], at[1])
            walk(part[np.argmax(at[:2, part].min(axis=0))], at[2])
        todo = [part]
        while todo:
            part = todo.pop()
            if len(part) <= near:
                out.append(part)
                continue
            axis = np.argmax(np.ptp(at[:, part], axis=1))
            part = part[np.argsort(at[axis, part], kind="stable")]
            half = max(len(part) // 2 // near, 1) * near
            todo += [part[half:], part[:half]]
    return np.concatenate(out)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A sample's nodes that have edges, near ones side by side, and their neighbours as places in that list, one node's behind the other's."""
    ids, src = np.unique(rows["src"].to_numpy(), return_inverse=True)
    dst = np.searchsorted(ids, rows["dst"].to_numpy())[np.argsort(src, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.bincount(src))]).astype(np.int64)
    order = _near_order(begins, dst)
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids))
    ends = rank[_neighbours(begins, dst, order)]
    begins = np.concatenate([[0], np.cumsum(np.diff(begins)[order])])
    return pd.DataFrame({"sample_id": rows["sample_id"].iloc[:1], "ids": [ids[order].tobytes()], "begins": [begins.tobytes()], "ends": [ends.tobytes()]})


def _searched(g: Graph, search: Callable, columns: tuple[str, ...], share: int = 1) -> tuple[DataFrame, Graph | None]:
    """(sample_id, node_id, *columns) summed over what ``search`` (begins, ends, first and last source) gives for the nodes, and the samples too large to pack.

    A task has ``share`` times ``TASK_WORK`` sources times edges.
    """
    edges = stored(g.both.groupBy("sample_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("src").alias("of")), "graph-sizes")
    large = edges.where(F.col("m") > PACKED_EDGES)
    fits = edges.where(F.col("m") <= PACKED_EDGES).withColumn("parts", F.least(F.ceil(F.col("m") * F.col("of") / (share * TASK_WORK)), F.col("of")).cast("int"))
    packed = g.both.join(fits, "sample_id", "left_semi").groupBy("sample_id").applyInPandas(_pack, "sample_id string, ids binary, begins binary, ends binary")
    tasks = min(max(fits.agg(F.sum("parts")).first()[0] or 1, 1), MOST_TASKS)
    shares = packed.join(fits, "sample_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, begins, ends = (np.frombuffer(b, t) for b, t in ((row.ids, np.int64), (row.begins, np.int64), (row.ends, np.int32)))
                found = search(begins, ends, row.part * len(ids) // row.parts, (row.part + 1) * len(ids) // row.parts)
                yield pd.DataFrame({"sample_id": row.sample_id, "node_id": ids} | dict(zip(columns, found, strict=True)))

    kinds = ", ".join(f"{c} {'long' if c in ('r', 'far') else 'double'}" for c in columns)
    found = shares.select("sample_id", "ids", "begins", "ends", "part", "parts").mapInPandas(run, f"sample_id string, node_id long, {kinds}")
    summed = found.groupBy("sample_id", "node_id").agg(*[F.sum(c).alias(c) for c in columns])
    return stored(summed, "searched"), None if large.isEmpty() else g.of_samples(large)


def _search_by_bits(begins: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """How many of the sources from ``first`` to ``last`` come to each node, and the sums of their distances and of the inverse ones.

    A level touches the neighbours of the nodes that sources came to on the last one, and leaves those that all of them have come to.
    """
    n, many = len(begins) - 1, np.diff(begins)
    # nodes by falling degree: those with a k-th neighbour come first; where few have one, their further neighbours are kept together
    by = np.argsort(-many, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    ends, begins = rank[_neighbours(begins, ends, by)], np.concatenate([[0], np.cumsum(many[by])])
    have = np.searchsorted(-many[by], -np.arange(many.max() + 1)).tolist()
    slots = sum(h >= FEW_HUBS for h in have)
    nth = [ends[begins[:h] + k] for k, h in enumerate(have[:slots])]
    further = [ends[begins[v] + slots : begins[v + 1]] for v in range(have[slots])]
    r, far, near, mark = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, dtype=bool)
    wide = 64 * min(HELD_WORDS, max(1, HELD_BITS // n))

    def reach(nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """How many of the sorted ``nodes``, from the first, have a k-th neighbour, and these, for each k."""
        for to in nth:
            h = int(np.searchsorted(nodes, len(to)))
            if not h:
                return
            yield h, to[nodes[:h]]

    def hubs(nodes: np.ndarray) -> Iterator[np.ndarray]:
        return (further[v] for v in nodes[: np.searchsorted(nodes, len(further))].tolist())

    for at in range(first, last, wide):
        source = np.sort(rank[at : min(at + wide, last)])
        place = np.arange(len(source))
        seen, come = np.zeros((n, (len(source) + 63) // 64), np.uint64), np.zeros(n, np.int64)
        seen[source, place // 64], come[source] = np.uint64(1) << (place % 64).astype(np.uint64), 1
        new, front, level = seen.copy(), source, 0
        while len(front):
            level += 1
            for _, to in reach(front):
                mark[to] = True
            for to in hubs(front):
                mark[to] = True
            here = np.flatnonzero(mark)
            mark[here] = False
            here = here[come[here] < len(source)]
            got = np.zeros((len(here), seen.shape[1]), np.uint64)
            for h, to in reach(here):
                got[:h] |= new.take(to, axis=0)
            for row, to in zip(got, hubs(here), strict=False):
                row |= np.bitwise_or.reduce(new.take(to, axis=0), axis=0)
            got &= ~seen.take(here, axis=0)
            new[front] = 0
            new[here] = got
            seen[here] |= got
            count = np.bitwise_count(got).sum(axis=1, dtype=np.int64)
            come[here] += count
            r[here], far[here], near[here] = r[here] + count, far[here] + count * level, near[here] + count / level
            front = here[count > 0]
    return r[rank], far[rank], near[rank]


def _search_paths(begins: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray]:
    """What the sources from ``first`` to ``last`` owe to each node: Brandes' sums over pairs of a source and a node."""
    n, many = len(begins) - 1, np.diff(begins)
    total = np.zeros(n)

    def ahead(front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of the pairs ``front``, as pairs, and how many each has."""
        node = front % n
        k = many[node]
        place = np.arange(k.sum()) + np.repeat(begins[node] - (np.cumsum(k) - k), k)
        return np.repeat(front - node, k) + ends[place], k

    for at in range(first, last, max(1, HELD_PATHS // n)):
        source = np.arange(at, min(at + max(1, HELD_PATHS // n), last))
        pairs = np.arange(len(source)) * n + source
        depth, paths, mark = np.full(len(source) * n, -1, np.int32), np.zeros(len(source) * n), np.empty(len(source) * n, np.int64)
        depth[pairs], paths[pairs], levels = 0, 1.0, [pairs]
        while len(levels[-1]):
            to, k = ahead(levels[-1])
            fresh = depth[to] < 0
            to, share = to[fresh], np.repeat(paths[levels[-1]], k)[fresh]
            np.add.at(paths, to, share)
            depth[to] = len(levels)
            mark[to] = np.arange(len(to))  # the last of equal pairs stays
            levels.append(to[mark[to] == np.arange(len(to))])
        owed = np.zeros(len(source) * n)
        for level in range(len(levels) - 1, 0, -1):
            here = levels[level]
            owed[here] *= paths[here]
            to, k = ahead(here)
            back = depth[to] == level - 1
            np.add.at(owed, to[back], np.repeat((1.0 + owed[here]) / paths[here], k)[back])
        owed[pairs] = 0.0
        total += owed.reshape(len(source), n).sum(axis=0)
    return (total,)


def reached(g: Graph) -> DataFrame:
    """(sample_id, node_id, r, far, near): how many others a node reaches, and the sums of their distances and of the inverse ones; nodes without edges may be left out."""
    found, large = _searched(g, _search_by_bits, ("r", "far", "near"), BITS_SHARE)
    return found if large is None else found.unionByName(_reached_by_joins(large))


def _reached_by_joins(g: Graph) -> DataFrame:
    """:func:`reached` of graphs of any size.

    Searches run side by side, 64 sources to a long: a row (word, v) has the sources that have come to v and those that came on the last level.
    Distances are the same both ways, so v counts the sources that come to it, and pairs of nodes are never written.
    """
    sources, batches = _batches(g, WORD_SOURCES)
    keys = ["sample_id", "word", "v"]
    zero = [F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("far"), F.lit(0.0).alias("near")]
    out = ["r", "far", "near"]
    totals: DataFrame | None = None
    for batch in range(batches):
        bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
        begin = sources.where(F.col("batch") == batch).select("sample_id", F.floor(F.col("place") / 64).alias("word"), F.col("node_id").alias("v"), bit.alias("seen"), bit.alias("new"), *zero)
        state, level = stored(begin, "words"), 0
        while state.where("new <> 0").limit(1).count():
            level += 1
            ahead = state.where("new <> 0").select("sample_id", "word", F.col("v").alias("src"), "new").join(g.both, ["sample_id", "src"])
            come = ahead.select("sample_id", "word", F.col("dst").alias("v"), F.lit(0).cast("long").alias("seen"), F.col("new").alias("got"), *zero)
            both = state.select(*keys, "seen", F.lit(0).cast("long").alias("got"), *out).unionByName(come)
            met = both.groupBy(*keys).agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"), *[F.sum(c).alias(c) for c in out])
            fresh = F.col("got").bitwiseAND(F.bitwise_not("seen"))
            n = F.bit_count("new")
            step = met.select(*keys, F.col("seen").bitwiseOR(F.col("got")).alias("seen"), fresh.alias("new"), *out)
            step = step.select(*keys, "seen", "new", (F.col("r") + n).alias("r"), (F.col("far") + n * level).alias("far"), (F.col("near") + n / level).alias("near"))
            state = stored(step, "words", replaces=state)
        part = state.groupBy("sample_id", F.col("v").alias("node_id")).agg(*[F.sum(c).alias(c) for c in out])
        if totals is not None:
            part = totals.unionByName(part).groupBy("sample_id", "node_id").agg(*[F.sum(c).alias(c) for c in out])
        totals = stored(part, "reached", replaces=totals)
        dropped(state)
    return totals if totals is not None else g.nodes.select("sample_id", "node_id", *zero)


def closeness(g: Graph, reach: DataFrame) -> DataFrame:
    """(r - 1)/sum of distances, times (r - 1)/(n - 1), with r reachable nodes, itself included; 0 for isolated ones."""
    value = F.col("r") / F.col("far") * F.col("r") / F.greatest(F.col("n") - 1, F.lit(1))
    return g.filled(reach.where("r > 0").join(g.nodes, ["sample_id", "node_id"]).select("sample_id", "node_id", value.alias("closeness")), "closeness")


def harmonic(g: Graph, reach: DataFrame) -> DataFrame:
    """Sum of inverse distances over n - 1."""
    value = F.col("near") / F.greatest(F.col("n") - 1, F.lit(1))
    return g.filled(reach.join(g.nodes, ["sample_id", "node_id"]).select("sample_id", "node_id", value.alias("harmonic")), "harmonic")


def shortest_paths(g: Graph, sources: DataFrame) -> list[DataFrame]:
    """Shortest paths from ``sources``, a table (sample_id, s, v, sigma) to a level; sigma counts them."""
    keys = ["sample_id", "s", "v"]
    levels = [stored(sources.select("sample_id", F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(1.0).alias("sigma")), "level")]
    while True:
        ahead = levels[-1].select("sample_id", "s", F.col("v").alias("src"), "sigma").join(g.both, ["sample_id", "src"])
        found = ahead.select("sample_id", "s", F.col("dst").alias("v"), "sigma", F.lit(False).alias("known"))
        # a neighbour of level l is on level l - 1, l or l + 1
        for old in levels[-2:]:
            found = found.unionByName(old.select(*keys, F.lit(0.0).alias("sigma"), F.lit(True).alias("known")))
        level = found.groupBy(*keys).agg(F.sum("sigma").alias("sigma"), F.max("known").alias("known")).where(~F.col("known")).drop("known")
        level = stored(level, "level")
        if not level.limit(1).count():
            dropped(level)
            return levels
        levels.append(level)


def _dependencies(g: Graph, levels: list[DataFrame]) -> DataFrame:
    """(sample_id, node_id, total): what the sources of ``levels`` owe to each node, passed back from the last level to the first. Levels are deleted once passed."""
    keys = ["sample_id", "s", "v"]
    owed: DataFrame | None = None  # (sample_id, s, v, delta) of the level above
    total: DataFrame | None = None
    last: DataFrame | None = None
    for level in range(len(levels) - 1, 0, -1):
        here = levels[level]
        rows = here.join(owed, keys, "left") if owed is not None else here.withColumn("delta", F.lit(None).cast("double"))
        rows = stored(rows.select(*keys, "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        part = rows.select("sample_id", F.col("v").alias("node_id"), F.col("delta").alias("total"))
        summed = part if total is None else total.unionByName(part)
        total = stored(summed.groupBy("sample_id", "node_id").agg(F.sum("total").alias("total")), "owed", replaces=total)
        back = rows.select("sample_id", "s", F.col("v").alias("dst"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("part")).join(g.both, ["sample_id", "dst"])
        before = levels[level - 1].select(*keys, F.col("sigma").alias("sigma_v"))
        owed = back.withColumnRenamed("src", "v").join(before, keys).groupBy(*keys).agg(F.sum(F.col("sigma_v") * F.col("part")).alias("delta"))
        if last is not None:
            dropped(last)
        dropped(here)
        last = rows
    for rest in (levels[0], last):
        if rest is not None:
            dropped(rest)
    return total if total is not None else g.nodes.select("sample_id", "node_id", F.lit(0.0).alias("total"))


def _owed_by_joins(g: Graph) -> DataFrame:
    """(sample_id, node_id, total) of graphs of any size, by batches of sources, so that only a batch's paths are on disk."""
    sources, batches = _batches(g, PATH_SOURCES)
    total: DataFrame | None = None
    for batch in range(batches):
        part = _dependencies(g, shortest_paths(g, sources.where(F.col("batch") == batch)))
        total = part if total is None else stored(total.unionByName(part).groupBy("sample_id", "node_id").agg(F.sum("total").alias("total")), "totals", replaces=total)
    return total if total is not None else g.nodes.select("sample_id", "node_id", F.lit(0.0).alias("total"))


def betweenness(g: Graph) -> DataFrame:
    """Brandes. Over ordered pairs, so divided by (n - 1)(n - 2)."""
    total, large = _searched(g, _search_paths, ("total",))
    if large is not None:
        total = total.unionByName(_owed_by_joins(large))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    value = F.when(pairs > 0, F.col("total") / F.nullif(pairs, F.lit(0))).otherwise(F.lit(0.0))
    return g.filled(total.join(g.nodes, ["sample_id", "node_id"]).select("sample_id", "node_id", value.alias("betweenness")), "betweenness")


def centralities(nodes: DataFrame, edges: DataFrame | EdgeBlocks, measures: list[str] | tuple[str, ...] = MEASURES, strict: bool = False) -> DataFrame:
    """(sample_id, node_id, a column per measure). A measure that fails is warned about and left out, or, if ``strict``, raised. What Spark can't run is raised in either case.

    Degree and clustering take blocks of edges as they are; for the other measures these are written as rows.
    """
    for m in measures:
        if m not in MEASURES:
            raise ValueError(f"{m!r} is no measure; there are {', '.join(MEASURES)}.")
    nodes = as_nodes(nodes, (0, 2, 3))
    g = Graph.of(nodes, edges)
    by_rows = cache(lambda: g if g.blocks is None else Graph.of(nodes, g.blocks.rows()))
    plain = {"degree": degree, "clustering": clustering, "pagerank": pagerank, "betweenness": betweenness}
    over_reach = {"closeness": closeness, "harmonic": harmonic}
    reach: DataFrame | None = None
    out = g.nodes.select("sample_id", "node_id")
    for m in dict.fromkeys(measures):
        try:
            if m in plain:
                column = plain[m](g if m in OF_BLOCKS else by_rows())
            else:
                reach = reached(by_rows()) if reach is None else reach
                column = over_reach[m](g, reach)
            out = stored(out.join(column, ["sample_id", "node_id"]), "scores")
        except Exception as problem:  # of any kind: the other measures don't depend on it
            if strict or isinstance(problem, (Py4JError, PySparkException)):
                raise
            warnings.warn(f"{m} failed and is left out: {problem}", UserWarning, stacklevel=2)
    return out
