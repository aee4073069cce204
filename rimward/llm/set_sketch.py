"""Near-duplicate documents by SetSketch registers over four-word shingles, verified on full sets.

Register i of a set is the largest value of floor(1 - log_b(h_i)) over its shingles, with h_i exponential with the rate ``RATE``, so registers are
truncated minima on an exponential scale. The registers of a union are the greater of both, so a long text's are merged from parts.
With b = ``BASE`` close to 1 two sets agree in a register about as often as their Jaccard similarity says. ``BANDS`` bands of ``ROWS`` registers
each make a signature; two sets of similarity 0.8 share none with a probability of (1 - 0.8^4)^32, five in a hundred million.

Pairs of sets that share a signature are first estimated: given both sizes, the likelihood of how many registers are greater, less and equal has one
maximum over the similarity. Pairs estimated ``MARGIN`` (over five standard errors) below the threshold are dropped; the others are verified on their full sets.
Which pairs are formed is the scheme of :mod:`rimward.llm.ngram_join`: in rounds each set meets one hub, then sets with few candidates meet
those, and what is left meets in blocks of bounded size, verified exactly. No link that joins components is left out, and no group is enumerated.

Edge cases. Null, empty and white texts have an empty set and no links; they are kept. Texts of fewer than four words are one shingle. Very long
texts are sketched in parts, whole. Null ids take part but never name a component, unless all its ids are null. Repeated
rows are documents of their own with equal sets, and rows that repeat a kept id are kept too. An empty table gives no rows. Other columns are ignored. Equal
64-bit hashes are taken as equal shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.components import connected_components
from rimward.llm import ngram_join as nj
from rimward.llm.common import materialize, slices

WORDS = 4
BANDS, ROWS = 32, 4
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Estimates this much below the threshold are dropped; similarities tried by the estimate; shingles sketched at once.
THRESHOLD, MARGIN, STEPS, PART = 0.8, 0.2, 200, 2_048

_FACTORS = nj._mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\x01" + b" ".join(words))] if words else [], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    many = len(words) - WORDS + 1
    mixed = np.zeros(many, dtype=np.uint64)
    for i in range(WORDS):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + many]
    return np.unique(nj._mix(mixed))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; zeros for the empty set."""
    out = np.zeros(BANDS * ROWS, dtype=np.uint16)
    for at in range(0, len(hashes), PART):
        least = (hashes[at : at + PART, None] * _FACTORS[None, :]).min(axis=0)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        values = np.floor(1.0 - np.log(exponential) / np.log(BASE))
        out = np.maximum(out, np.clip(values, 0, LIMIT + 1).astype(np.uint16))
    return out


def band_signatures(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit signature for each band of a sketch's registers."""
    packed = sketch.reshape(BANDS, ROWS).astype(np.uint64) << (np.arange(ROWS, dtype=np.uint64) * np.uint64(16))
    return nj._mix(packed.sum(axis=1) ^ nj._mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def estimates(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The similarities of pairs of sets that are likeliest for their registers (a row each), the sizes being known."""
    more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    same = x.shape[1] - more - less
    u = (n_x / (n_x + n_y))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0.0, 1.0, STEPS + 1)[None, :]
    chance = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    log = lambda z: np.log(np.maximum(z, 1e-300))
    best = np.argmax(more * log(p) + less * log(q) + same * log(1 - p - q), axis=1)
    return j[np.arange(len(best)), best]


def sketched_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, n_shingles, sketch)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([nj._set_id(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "set_id", "n_shingles", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(sketch, f"doc_id {kind}, text_hash long, set_id long, n_shingles long, sketch binary")


def signature_rows(sketches: DataFrame) -> DataFrame:
    """(signature, set_id) of rows (set_id, sketch)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_signatures(np.frombuffer(b, np.uint16)) for b in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.array([], np.int64)), pa.array(ids)], names=["signature", "set_id"])

    return sketches.select("set_id", "sketch").mapInArrow(sign, "signature long, set_id long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, hashes) of the texts whose hashes are in ``wanted`` (text_hash)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([nj._set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"])

    texts = docs.select(F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    found = texts.join(F.broadcast(wanted) if wanted.count() <= nj.BROADCAST_ROWS else wanted, "text_hash", "left_semi")
    return found.dropDuplicates(["text_hash"]).select("text").mapInArrow(build, "set_id long, hashes binary").dropDuplicates(["set_id"])


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate isn't far below the threshold."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            near = estimates(x, y, *(batch.column(c).to_numpy() for c in ("n_x", "n_y"))) >= THRESHOLD - MARGIN if batch.num_rows else []
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda c, s: sketches.select(F.col("set_id").alias(c), F.col("sketch").alias(s), F.col("n_shingles").alias(f"n_{s}"))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(judge, "a long, b long")


def set_links(shared: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different sets that join the same sets as all links between sets of one signature do; ``shared`` is a stored table (signature, set_id, size)."""
    verified = lambda pairs, label: materialize(nj._linked(materialize(likely(pairs, sketches), "likely"), sets), label)
    rank = shared.groupBy("set_id").agg(F.sum("size").alias("rank"))
    held = materialize(shared.join(rank, "set_id"), "ranked", replaces=shared)
    rows = held.withColumn("component", F.col("set_id"))
    tested = links = None
    for _ in range(nj.HUB_ROUNDS):
        pairs = materialize(nj.hub_pairs(rows, tested), "hub-pairs")
        found = verified(pairs, "hub-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        components = connected_components(links).withColumnRenamed("node", "set_id")
        rows = held = materialize(nj._open_groups(rows.drop("component"), components), "open-signatures", replaces=held)
        if rows.isEmpty():
            return links
    pairs, dense = nj.sparse_pairs(rows, nj.SPARSE)
    links = links.unionByName(verified(pairs.join(tested, ["a", "b"], "left_anti"), "sparse-links"))
    return links.unionByName(materialize(nj._blocks(nj.dense_clusters(dense), sets), "block-links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch, component_id, kept) per row; component_id is the smallest id reachable by links, ``kept`` marks the rows that have it."""
    signed = materialize(sketched_documents(docs), "sketched")
    sketches = signed.where("n_shingles >= 4").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash"))
    sketches = materialize(sketches, "sketches")
    rows = materialize(signature_rows(sketches), "signatures")
    sizes = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "signature"), "shared", replaces=rows)
    met = materialize(sketches.join(shared.select("set_id").distinct(), "set_id", "left_semi"), "met")
    sets = materialize(full_sets(docs, met.select("text_hash").distinct()), "sets")
    components = connected_components(set_links(shared, met.drop("text_hash"), sets)).withColumnRenamed("node", "set_id")
    least = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    labels = materialize(least.join(components, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "set-labels")
    lowest = materialize(labels.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    labels = materialize(labels.join(lowest, "component").select("set_id", "component_id"), "labels")
    out = signed.join(labels, "set_id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "set_id", "sketch", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
