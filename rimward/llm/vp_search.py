"""Nearest neighbours by a vantage-point tree per shard.

Candidates are dealt to the nearest of up to ``CELLS`` pivots, and a cell's rows are dealt by a hash of their place to shards of bounded rows and bytes, so that
neither equal vectors nor the order of rows make uneven shards. A shard holds a vantage-point tree over all its rows: a node splits its rows by
the median distance to a vantage point; leaves hold up to ``LEAF`` rows. A query goes to the shards of the cells that
the triangle inequality leaves, and descends there into a child unless the inequality says
that nothing in it is nearer than its current k-th candidate. ``factor`` relaxes that pruning: at 1 the search
is exact, below 1 a cell or node is left out sooner. Shards return each query's k best, and a window keeps the best k.

Before the search, each query's k-th distance to a bounded sample of the candidates (``SEED_ROWS``) gives a radius
that its k nearest can't exceed, so shards prune from the start and return little. Candidates and queries meet by one shuffle; a task
reads a shard's rows, builds its tree once and searches the queries that follow in blocks. The driver holds the sample and a row per cell.

Edge cases. Vectors that are null, zero, or hold null or non-finite components, or with another length
than the most frequent one of all usable rows (the smaller one of a tie), take no part; neither do rows with a null id. A query's own id isn't its candidate, so repeated
rows of one id never find each other. Candidates and queries are rows: a repeated row is as many candidates, and may take
as many ranks; the pairs of all query rows of one id are ranked together, a pair as often as its query row is repeated. Ties go to the smaller id. Fewer than k candidates give all of them. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import materialize

LEAF = 256
#: Queries searched at once, least and most rows of a shard's tree, rows of the sample that gives radii, and of that the pivots of cells.
QUERY_BLOCK, LEAST_ROWS, SHARD_ROWS, SEED_ROWS, CELLS = 4096, 4096, 65_536, 4096, 256
#: Bytes of a shard's vectors, which bound its rows where vectors are long.
SHARD_BYTES = 256 << 20


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part, but for the length."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(whole & F.exists("vector", lambda x: x != 0.0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def exact_distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of paired rows, by differences in double precision, added in the order of components."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += (queries[:, j] - rows[:, j]) ** 2
    return np.sqrt(total)


def _slack(width: int) -> float:
    """Above the relative rounding error of sums of ``width`` squares or products, in any order."""
    return 4.0 * (width + 4) * np.finfo(np.float64).eps


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by a^2 + b^2 - 2ab, and what each may be off by: near zero that's far more than relative rounding."""
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return sizes - 2.0 * (a @ b.T), _slack(a.shape[1]) * sizes


def _gaps(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances to a point, by differences, so within ``_slack`` of themselves."""
    apart = rows - point
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: np.ndarray | None = None
    near: Node | None = None
    far: Node | None = None
    bounds: tuple = field(default=())  # least and largest distance to the point, near and far


def build_tree(vectors: np.ndarray, rows: np.ndarray | None = None, seed: int = 0) -> Node:
    rows = np.arange(len(vectors)) if rows is None else rows
    if len(rows) <= LEAF:
        return Node(rows=rows)
    point = vectors[rows[np.random.default_rng(seed + len(rows)).integers(len(rows))]]
    gaps = _gaps(vectors[rows], point)
    order = np.argsort(gaps, kind="stable")
    half = len(rows) // 2
    gaps, rows = gaps[order], rows[order]
    return Node(
        point=point, near=build_tree(vectors, rows[:half], seed + 1), far=build_tree(vectors, rows[half:], seed + 2),
        bounds=(gaps[0], gaps[half - 1], gaps[half], gaps[-1]),
    )


class Search:
    """The k best of one shard for one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int, factor: float):
        self.ids, self.vectors, self.query_ids, self.queries, self.k, self.factor = ids, vectors, query_ids, queries, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1)
        self.radius, self.slack = radius.copy(), _slack(queries.shape[1])

    def run(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.rows is not None:
            self._leaf(node.rows, active)
            return
        gaps = _gaps(self.queries[active], node.point)
        low, inner, outer, high = node.bounds
        to_near = np.maximum(np.maximum(gaps - inner, low - gaps), 0.0)
        to_far = np.maximum(np.maximum(outer - gaps, gaps - high), 0.0)
        first = to_near <= to_far
        for pick, gap, child in ((first, to_near, node.near), (~first, to_far, node.far), (~first, to_near, node.near), (first, to_far, node.far)):
            reach = self.factor * self.radius[active] * (1 + self.slack) + self.slack * (gaps + high)
            self.run(child, active[pick & (gap <= reach)])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        squares, off = _squares(self.queries[active], self.vectors[rows])
        squares[self.query_ids[active][:, None] == self.ids[rows][None, :]] = np.inf
        some = (squares <= (self.radius[active] ** 2 * (1 + self.slack))[:, None] + off) & np.isfinite(squares)
        hit = some.any(axis=1)
        if not hit.any():
            return
        at, (q, r) = active[hit], np.nonzero(some[hit])
        exact = exact_distances(self.queries[at[q]], self.vectors[rows[r]])
        fresh, names = np.full((len(at), len(rows)), np.inf), np.broadcast_to(rows, (len(at), len(rows)))
        fresh[q, r] = exact
        gaps, names = np.hstack([self.best[at], fresh]), np.hstack([self.found[at], names])
        order = np.lexsort((np.where(names >= 0, self.ids[names], 0), gaps), axis=1)[:, : self.k]
        self.best[at], self.found[at] = np.take_along_axis(gaps, order, 1), np.take_along_axis(names, order, 1)
        self.radius[at] = np.minimum(self.radius[at], self.best[at, -1])


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the distance to it."""
    cell, gap = np.zeros(len(vectors), dtype=np.int32), np.full(len(vectors), np.inf)
    for i, pivot in enumerate(pivots):
        own = _gaps(vectors, pivot)
        nearer = own < gap
        cell[nearer], gap[nearer] = i, own[nearer]
    return cell, gap


def _radii(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each query's k nearest lie: its k-th to the sample, as far as rounding may have moved it."""
    squares, off = _squares(vectors, seeds)
    most = np.maximum(squares, 0.0) + off
    most[ids[:, None] == seed_ids[None, :]] = np.inf
    return np.sqrt(np.partition(most, k - 1, axis=1)[:, k - 1]) if most.shape[1] >= k else np.full(len(ids), np.inf)


def nearest(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, id, score): the k rows of ``df`` nearest to each row of ``queries``, both with the same columns."""
    spark = df.sparkSession
    base, asked = usable(df, id_col, vector_col), usable(queries, id_col, vector_col)
    lengths = base.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    width = lengths["width"]
    base, asked = base.where(F.size("vector") == width), asked.where(F.size("vector") == width)
    seeds = base.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS).toPandas()
    sent = spark.sparkContext.broadcast((seeds["id"].to_numpy(), np.stack(seeds["vector"].to_list())))
    most = max(LEAF, min(SHARD_ROWS, SHARD_BYTES // (8 * width)))
    n_cells = min(CELLS, len(seeds), max(1, lengths["count"] // most))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value[1][:n_cells]
        for batch in batches:
            cell, gap = _nearest_pivot(_matrix(batch.column(1)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=["id", "vector", "cell", "gap"])

    dealt = base.mapInArrow(deal, "id long, vector array<double>, cell int, gap double")
    dealt = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "vp-cells")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("gap").alias("low"), F.max("gap").alias("high")).orderBy("cell").toPandas()
    rows = int(np.clip(lengths["count"] // (4 * spark.sparkContext.defaultParallelism), min(LEAST_ROWS, most), most))
    cells["shards"] = -(-cells["rows"] // rows)
    cells["first"] = cells["shards"].cumsum() - cells["shards"]
    layout = spark.createDataFrame(cells[["cell", "shards", "first"]].astype("int32"), "cell int, shards int, first int")
    shard = (F.col("first") + F.pmod(F.xxhash64("place"), F.col("shards"))).cast("int")
    candidates = dealt.join(F.broadcast(layout), "cell").select(shard.alias("shard"), F.lit(False).alias("asks"), "id", "vector", F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("times"))
    # a repeated query row is searched once
    asked = asked.groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    sent_cells = spark.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (seed_ids, seed_rows), cells = sent.value, sent_cells.value
        pivots, low, high = seed_rows[cells["cell"].to_numpy()], cells["low"].to_numpy(), cells["high"].to_numpy()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            radius = _radii(ids, vectors, seed_ids, seed_rows, k)
            gaps, slack = np.stack([_gaps(vectors, p) for p in pivots], axis=1), _slack(vectors.shape[1])
            apart = np.maximum(np.maximum(gaps - high, low - gaps), 0.0)
            reached = apart <= (factor * radius * (1 + slack))[:, None] + slack * (gaps + high)
            lists = [np.concatenate([np.arange(a, a + n) for a, n in zip(cells["first"][r], cells["shards"][r], strict=True)]) if r.any() else np.array([], np.int64) for r in reached]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radius), pa.array(lists, pa.list_(pa.int32()))], names=["id", "vector", "times", "radius", "shards"])

    routed = asked.select("id", "vector", "times").mapInArrow(route, "id long, vector array<double>, times long, radius double, shards array<int>")
    routed = routed.select(F.explode("shards").alias("shard"), F.lit(True).alias("asks"), "id", "vector", "radius", "times")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, waiting, tree = None, [], [], None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, waiting
            if waiting and held:
                if tree is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    rows = np.ascontiguousarray(_matrix(table.column("vector").combine_chunks()))
                    tree = table.column("id").to_numpy(), rows, build_tree(rows)
                ask = pa.Table.from_batches(waiting).combine_chunks()
                ids, vectors = ask.column("id").to_numpy(), np.ascontiguousarray(_matrix(ask.column("vector").combine_chunks()))
                run = Search(tree[0], tree[1], ids, vectors, ask.column("radius").to_numpy(), k, factor)
                run.run(tree[2], np.arange(len(ids)))
                q, r = np.nonzero(np.isfinite(run.best))
                times = ask.column("times").to_numpy()[q]
                q, r = np.repeat(q, times), np.repeat(r, times)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(tree[0][run.found[q, r]]), pa.array(run.best[q, r])], names=["query_id", "id", "score"])
            waiting = []

        for batch in batches:  # in order of shards, each one's candidates before its queries
            names, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != shard:
                    yield from answer()
                    shard, held, tree = names[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                for at in range(a, b, QUERY_BLOCK):
                    waiting.append(batch.slice(at, min(QUERY_BLOCK, b - at)))
                    if sum(w.num_rows for w in waiting) >= QUERY_BLOCK:
                        yield from answer()
        yield from answer()

    met = candidates.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
