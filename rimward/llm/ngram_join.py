"""Jaccard join of documents on five-word shingles with PartEnum signatures.

Every text becomes a set of 64-bit shingle hashes; equal sets are one set from then on. Two sets of sizes
a <= b reach the similarity of 4/5 only if b <= 5a/4 and their symmetric difference is at most (a + b)/9. Sizes
are banded so that such a pair lies in one band or two neighbouring ones; *instance* i joins pairs whose
smaller set is in band i, with the bound k of that band. The feature domain is cut by hash into n1 parts of
three cells. At most k/2 parts hold two or more differences, so in the n1 - k/2 other parts at least two of
three cells are equal: each pair of cells of each part is a signature, and similar sets share one.

Two safe reductions come first. (1) In a similar pair at most a fifth of a set's shingles are foreign to its
partner. A hash range with ``SAMPLE`` of all shingles is counted; sets with more than a fifth of their shingles
proven foreign to every other set take no part. All shingles of the sets that are left are counted once more, among
those sets alone. (2) A signature over empty cells is left out by sets in
which parts with empty cell pairs are fewer than the n1 - k/2 parts that must agree: one of those
has content, and its signature is shared.

Sets that share a signature form a group, and what is sought is links that join components. In each of ``HUB_ROUNDS``
rounds a set is compared with one *hub*, the set with most shared signatures of the largest group whose hub isn't
in its component yet. Groups that then lie in one component are done. In the others a set's candidates are the
members of other components. Sets with up to ``SPARSE`` candidates are compared with each of them, so pairs grow with the sets.
What is left are pairs of sets that both have more: the groups join those to clusters, which are cut into
blocks of bounded size, and a task finds which components two blocks link. So no link between components is
lost, though pairs are not enumerated.

Edge cases. Texts that are null, empty or white space have an empty set and no links. Texts of fewer than
five words are one shingle, the whole sequence. Null ids take part but never name a component, unless all
its ids are null. Repeated rows are documents of their own with equal sets. An empty table gives no rows.
Other columns are ignored. Equal 64-bit hashes are taken as equal shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import forget, materialize, slices
from rimward.components import connected_components

WORDS = 5
#: The share of the hash range in which shingles are counted for reduction (1), and entries per bucket of it.
SAMPLE, BUCKET_ENTRIES = 0.3, 250_000
#: Hashes of sets up to this many are broadcast to pick their texts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts per (k + 1)/2, see above: a fifth of the parts at least must agree.
SPARE = 1.25

#: Rounds of hubs; candidates of a set up to which pairs are made; shingles and sets in a block of a cluster; columns and rows of a matrix at once.
HUB_ROUNDS, SPARSE, BLOCK_SHINGLES, BLOCK_SETS, CHUNK_COLUMNS, CHUNK_ROWS = 2, 16, 400_000, 2_048, 2_048, 256

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))] if words else [], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    many = len(words) - WORDS + 1
    mixed = each[:many].copy()
    for i in range(1, WORDS):
        mixed = mixed * _STEP + each[i : i + many]
    return np.unique(_mix(mixed))


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def signed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, n_shingles, sampled): the set of each document and its hashes in the counted range."""
    limit = np.uint64(int(SAMPLE * 2**64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            sets = [shingle_hashes(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s[: np.searchsorted(s, limit)].tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "set_id", "n_shingles", "sampled"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(sign, f"doc_id {kind}, text_hash long, set_id long, n_shingles long, sampled binary")


def _two_of_each(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, id) in order, two for each hash at most."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    hashes, ids = hashes[fresh], ids[fresh]
    keep = np.ones(len(hashes), dtype=bool)
    keep[2:] = hashes[2:] != hashes[:-2]
    return hashes[keep], ids[keep]


def foreign_counts(frame: DataFrame) -> DataFrame:
    """(set_id, n_foreign) of (set_id, hashes): how many of a set's hashes no other set has. Sets without any may be missing."""
    total = frame.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0] // 8
    buckets = max(1, -(-total // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 2_000):
            parts = [np.frombuffer(b, dtype=np.uint64) for b in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            hashes, ids = _two_of_each(np.concatenate(parts) if parts else np.array([], np.uint64), ids)
            bucket = (_mix(hashes) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            hashes, ids, bucket = hashes[order], ids[order], bucket[order]
            names, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:], len(bucket)][: len(starts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                names=["bucket", "hashes", "ids"],
            )

    def foreign(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, ids = _two_of_each(np.frombuffer(b"".join(rows["hashes"]), np.uint64), np.frombuffer(b"".join(rows["ids"]), np.int64))
        alone = np.ones(len(hashes), dtype=bool)
        same = hashes[1:] == hashes[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        sets, counts = np.unique(ids[alone], return_counts=True)
        part = (_mix(sets.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, starts = np.unique(part[order], return_index=True)
        packed = [np.split(x[order], starts[1:]) if len(names) else [] for x in (sets, counts)]
        return pd.DataFrame({"part": names, "sets": pd.Series([x.tobytes() for x in packed[0]], dtype=object), "counts": pd.Series([x.tobytes() for x in packed[1]], dtype=object)})

    def total_of(rows: pd.DataFrame) -> pd.DataFrame:
        sets, at = np.unique(np.frombuffer(b"".join(rows["sets"]), np.int64), return_inverse=True)
        return pd.DataFrame({"set_id": sets, "n_foreign": np.bincount(at, weights=np.frombuffer(b"".join(rows["counts"]), np.int64)).astype(np.int64)})

    dealt = frame.select("set_id", "hashes").mapInArrow(deal, "bucket long, hashes binary, ids binary")
    # a bucket's counts travel packed, so that rows don't grow with sets times buckets
    parts = dealt.groupBy("bucket").applyInPandas(foreign, "part long, sets binary, counts binary")
    return parts.groupBy("part").applyInPandas(total_of, "set_id long, n_foreign long")


def _partnered(sets: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows of ``sets`` with at most a fifth of ``n_shingles`` foreign to all others."""
    return sets.join(counted, "set_id", "left").where(5 * F.coalesce("n_foreign", F.lit(0)) <= F.col("n_shingles")).drop("n_foreign")


def possible_sets(signed: DataFrame) -> DataFrame:
    """(set_id, n_shingles, text_hash) of the sets that may have a partner; text_hash is that of one of their texts."""
    counted = foreign_counts(signed.select("set_id", F.col("sampled").alias("hashes")))
    sets = signed.where("n_shingles >= 4").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.min("text_hash").alias("text_hash"))
    return _partnered(sets, counted)


def _full_sets(docs: DataFrame, possible: DataFrame) -> DataFrame:
    """(set_id, hashes) of the possible sets, from their texts."""
    wanted = possible.select("text_hash").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_hashes(t) for t in batch.column(0).slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"])

    texts = docs.select(F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text")).join(wanted, "text_hash", "left_semi")
    return texts.dropDuplicates(["text_hash"]).select("text").mapInArrow(build, "set_id long, hashes binary").dropDuplicates(["set_id"])


@lru_cache(maxsize=1)
def band_edges() -> np.ndarray:
    """The first size of each band; a partner of a set of one band is in the same, the one before or the one after."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 5 // 4 + 1)
    return np.array(edges)


def signatures(hashes: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a set, for its band's instance and the one before."""
    edges = band_edges()
    band = int(np.searchsorted(edges, len(hashes), side="right")) - 1
    out = []
    for instance in (band, band - 1):
        if instance < 0:
            continue
        k = int(edges[instance + 1] - 1) // 4
        if k == 0:
            continue
        parts = int(np.ceil(SPARE * (k + 1) / 2))
        spread = _mix(hashes + np.uint64(instance * int(_STEP) % 2**64))
        cell = (spread % np.uint64(3 * parts)).astype(np.int64)
        sums, counts = np.zeros(3 * parts, dtype=np.uint64), np.bincount(cell, minlength=3 * parts)
        np.add.at(sums, cell, _mix(spread ^ _M1))
        sums, counts = _mix(sums).reshape(-1, 3), counts.reshape(-1, 3)
        labels = np.arange(parts, dtype=np.uint64) * np.uint64(3) + np.uint64(instance << 40)
        pairs = ((0, 1), (0, 2), (1, 2))
        keys = np.stack([_mix(sums[:, i] * _M2 + sums[:, j] * _STEP + _mix(labels + np.uint64(n))) for n, (i, j) in enumerate(pairs)], axis=1)
        full = np.stack([counts[:, i] + counts[:, j] > 0 for i, j in pairs], axis=1)
        agreeing = parts - k // 2
        out.append(keys[full] if (~full.all(axis=1)).sum() < agreeing else keys.ravel())
    return np.concatenate(out).view(np.int64) if out else np.array([], dtype=np.int64)


def _signature_rows(sets: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [signatures(np.frombuffer(b, np.uint64)) for b in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.array([], np.int64)), pa.array(ids)], names=["signature", "set_id"])

    return sets.mapInArrow(sign, "signature long, set_id long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets with 100 * intersection >= 80 * union."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                near = 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y))
                ok.append(near and 180 * len(np.intersect1d(x, y, assume_unique=True)) >= 80 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within clusters: rows (set_id, cluster, component), cut into blocks that meet pair by pair.

    Only sets of one instance meet, as for signatures, so that rows of very different sizes stay apart.
    """
    edges = F.array(*[F.lit(int(e)) for e in band_edges()])
    sized = members.join(sets, "set_id").withColumn("n", (F.octet_length("hashes") / 8).cast("long"))
    band = F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1
    sized = sized.withColumn("instance", F.explode(F.array(band, band - 1)))
    most = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS))
    cut = sized.groupBy("cluster", "instance").agg(most.cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = sized.join(cut.select("cluster", "instance", "blocks"), ["cluster", "instance"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", "instance", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "component", "hashes")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(times > 1) - 1
        row, column = np.repeat(np.arange(len(sets)), sizes)[times[column] > 1], common[column[times[column] > 1]]
        block, ids, component = (rows[c].to_numpy() for c in ("block", "set_id", "component"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        place = np.zeros(len(sets), dtype=np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        both = np.zeros((len(left), len(right)), dtype=np.int32)
        for at in range(0, int(common[-1]) + 1 if len(common) else 0, CHUNK_COLUMNS):
            here = (column >= at) & (column < at + CHUNK_COLUMNS)
            x, y = np.zeros((len(left), CHUNK_COLUMNS), np.float32), np.zeros((len(right), CHUNK_COLUMNS), np.float32)
            for side, dense in ((i, x), (j, y)):
                mine = here & (block[row] == side)
                dense[place[row[mine]], column[mine] - at] = 1
            for at_row in range(0, len(left), CHUNK_ROWS):
                both[at_row : at_row + CHUNK_ROWS] += (x[at_row : at_row + CHUNK_ROWS] @ y.T).astype(np.int32)  # at most CHUNK_COLUMNS each, so exact
        found = []
        for at_row in range(0, max(1, len(left)), CHUNK_ROWS):  # a block may be empty
            few = left[at_row : at_row + CHUNK_ROWS]
            near = 180 * both[at_row : at_row + CHUNK_ROWS].astype(np.int64) >= 80 * (sizes[few][:, None] + sizes[right][None, :])
            near &= component[few][:, None] != component[right][None, :]
            p, q = np.nonzero(near)
            found.append((p + at_row, q))
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        _, first = np.unique(np.stack([component[left[p]], component[right[q]]], axis=1), axis=0, return_index=True)  # one link for two components
        return pd.DataFrame({"a": ids[left[p[first]]], "b": ids[right[q[first]]]})

    # dealt by all four: the join above has dealt by the first two, which would put all of a cluster's blocks in one task
    rows = rows.repartition("cluster", "instance", "i", "j")
    return rows.groupBy("cluster", "instance", "i", "j").applyInPandas(meet, "a long, b long")


_ENDS = (F.least, "a"), (F.greatest, "b")


def _pair(one: str, other: str) -> list:
    return [of(one, other).alias(name) for of, name in _ENDS]


def _open_groups(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows`` (signature, set_id, size, rank) with each set's component, of the groups that lie in several."""
    held = rows.join(components, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    several = held.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return held.join(several.select("signature"), "signature", "left_semi")


def hub_pairs(rows: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """One pair (a, b) at most for each set: with the hub of the largest of its groups whose hub is of another component, but for pairs in ``tested``."""
    hubs = rows.groupBy("signature").agg(F.max(F.struct("rank", F.col("set_id").alias("hub"), F.col("component").alias("of"))).alias("h"))
    spokes = rows.join(hubs, "signature").where("component <> h.of").select("set_id", "size", F.col("h.hub").alias("hub"))
    spokes = spokes.groupBy("set_id", "hub").agg(F.max("size").alias("size"))
    if tested is not None:
        spokes = spokes.select("*", *_pair("set_id", "hub")).join(tested, ["a", "b"], "left_anti")
    chosen = spokes.groupBy("set_id").agg(F.max(F.struct("size", "hub"))["hub"].alias("hub"))
    return chosen.select(*_pair("set_id", "hub")).distinct()


def sparse_pairs(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of sets of different components in one group of which one set has up to ``limit`` candidates, and the rows of the sets with more.

    In a group of more than 2 * ``limit`` sets only a member of its largest component can have so few, and then the
    other components have ``limit`` members at most. So no more pairs than ``limit`` times the sets are made.
    """
    own = rows.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("own"))
    whole = own.groupBy("signature").agg(F.sum("own").alias("all"), F.max(F.struct("own", "component"))["component"].alias("major"))
    rows = rows.select("signature", "set_id", "component").join(own, ["signature", "component"]).join(whole, "signature")
    rows = rows.join(rows.groupBy("set_id").agg((F.sum(F.col("all") - F.col("own")) > limit).alias("dense")), "set_id")
    rows = materialize(rows, "open-groups")
    p, q = rows.alias("p"), rows.alias("q")
    same = F.col("p.signature") == F.col("q.signature")
    few = ~(F.col("p.dense") & F.col("q.dense"))
    small = p.where(F.col("all") <= 2 * limit).join(q.where(F.col("all") <= 2 * limit), same & (F.col("p.component") < F.col("q.component")) & few)
    large = p.where((F.col("all") > 2 * limit) & ~F.col("dense") & (F.col("component") == F.col("major"))).join(q.where("component <> major"), same)
    pairs = [x.select(*_pair("p.set_id", "q.set_id")) for x in (small, large)]
    return pairs[0].unionByName(pairs[1]).distinct(), rows.where("dense").select("signature", "set_id", "component")


def dense_clusters(rows: DataFrame) -> DataFrame:
    """(set_id, cluster, component) of the rows (signature, set_id, component), for clusters of several components; sets of one group are in one cluster."""
    least = rows.groupBy("signature").agg(F.min("set_id").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    stars = rows.join(least.select("signature", "first"), "signature").select(F.col("first").alias("a"), F.col("set_id").alias("b")).where("a <> b").distinct()
    clusters = connected_components(stars).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    return clusters.join(rows.select("set_id", "component").distinct(), "set_id")


def set_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between different sets that join the same sets as all links do."""
    rows = _signature_rows(sets)
    sizes = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "signature"), "signatures")
    rank = shared.groupBy("set_id").agg(F.sum("size").alias("rank"))
    held = materialize(shared.join(rank, "set_id"), "ranked", replaces=shared)
    rows = held.withColumn("component", F.col("set_id"))
    tested = links = None
    for _ in range(HUB_ROUNDS):
        pairs = materialize(hub_pairs(rows, tested), "hub-pairs")
        found = materialize(_linked(pairs, sets), "hub-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        components = connected_components(links).withColumnRenamed("node", "set_id")
        rows = held = materialize(_open_groups(rows.drop("component"), components), "open-signatures", replaces=held)
        if rows.isEmpty():
            return links
    pairs, dense = sparse_pairs(rows, SPARSE)
    links = links.unionByName(materialize(_linked(pairs.join(tested, ["a", "b"], "left_anti"), sets), "sparse-links"))
    return links.unionByName(materialize(_blocks(dense_clusters(dense), sets), "block-links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, component, component_id) per row of ``docs``; component tells components apart, component_id is the smallest id reachable by links."""
    signed = materialize(signed_documents(docs), "signed")
    possible = materialize(possible_sets(signed), "possible")
    sets = materialize(_full_sets(docs, possible), "sets")
    sets = materialize(_partnered(sets.withColumn("n_shingles", F.octet_length("hashes") / 8), foreign_counts(sets)).select("set_id", "hashes"), "partnered-sets")
    components = connected_components(set_links(sets)).withColumnRenamed("node", "set_id")
    # the least id of a set, then of a component; the joins below read written tables, so that a hot set or component can be split
    least = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    labels = materialize(least.join(components, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "set-labels")
    lowest = materialize(labels.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    labels = materialize(labels.join(lowest, "component").select("set_id", "component", "lowest"), "labels")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(labels, "set_id", "left")
    return rows.select(
        "doc_id", "text_hash", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("component"),
        F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"),
    )
