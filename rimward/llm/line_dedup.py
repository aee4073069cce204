"""Line deduplication over sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. The exact table
holds, per 128-bit hash of a key, the number of documents that have it. Keys found in at least
``min_docs`` documents are *repeated*; each shard's cuckoo filter holds the repeated keys. Both support
insertion and deletion of documents, so the work is reversible: deleting what was inserted gives the
former table and filters that answer as before.

A filter may answer yes for a key it doesn't hold. All keys of the corpus are in the exact table, so those
answers are known beforehand: the table's other keys are probed once, and the few that hit are listed as
exceptions. Pruning is therefore exact. Small filters are broadcast; others stay in their shards, to which
line hashes, or the exact table's when exceptions are listed, are dealt.

Edge cases. A null or empty text is one empty line. Empty keys are never repeated. Repeated rows are
separate documents. Very long texts are read whole, one at a time. Null ids are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import forget, materialize, slices

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 500
#: Filters and exceptions up to this size are broadcast; beyond it line hashes are dealt to the filters' shards.
BROADCAST_BYTES = 32 << 20
#: Copies of a shard's filter among which its line hashes are dealt, so that no line, however frequent, fills one task.
SALTS = 16
KEYS_PER_SHARD = 50_000

COUNT_SCHEMA = "h1 long, h2 long, n_docs long"
FILTER_SCHEMA = "shard int, n_keys long, slots binary"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _text_bytes(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashes(keys: list[bytes]) -> np.ndarray:
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    return np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The exact table of ``docs``: (h1, h2, n_docs). Each task counts its rows by the thousand before Spark does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in slices(batches, 2_000):
            found: dict[bytes, int] = {}
            for text in part.column(0).to_pylist():
                for key in set(map(line_key, _text_bytes(text).split(b"\n"))):
                    if key and _long_enough(key, min_chars):
                        found[key] = found.get(key, 0) + 1
            pairs = _hashes(list(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(list(found.values()), pa.int64())],
                names=["h1", "h2", "n_docs"],
            )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, COUNT_SCHEMA)
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; the second bucket of a key follows from the first and its fingerprint."""

    def __init__(self, buckets: int):
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8) + 1)))))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        out = cls(0)
        out.slots = np.frombuffer(blob, dtype="<u2").reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = len(self.slots) - 1
        mark = (h2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (h1.astype(np.uint64) >> np.uint64(8)).astype(np.int64) & mask
        return mark, first, first ^ (mark * 0x5BD1E995 & mask)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(h1, h2)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Insert all; False when the filter is too full, and must be rebuilt larger."""
        mask = len(self.slots) - 1
        for mark, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            at = a if (self.slots[a] == 0).any() else b
            for kick in range(MAX_KICKS):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
                slot = (kick + at) % SLOTS
                mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
                at ^= mark * 0x5BD1E995 & mask
            else:
                return False
        return True

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for at in (a, b):
                here = np.flatnonzero(self.slots[at] == mark)
                if len(here):
                    self.slots[at, here[0]] = 0
                    break


def _built(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    room = len(h1)
    while not (out := CuckooFilter.sized_for(room)).add(h1, h2):
        room = 2 * room + SLOTS
    return out


def _shard(shards: int):
    return F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("int")


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> 40) % shards).astype(np.int64)


def build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """One cuckoo filter per shard over the repeated keys."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        made = _built(rows["h1"].to_numpy(), rows["h2"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "n_keys": [len(rows)], "slots": [made.to_bytes()]})

    keys = counts.where(F.col("n_docs") >= min_docs).select("h1", "h2", _shard(shards).alias("shard"))
    return keys.groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


@dataclass
class LineIndex:
    """The exact table, the filters over its repeated keys and the parameters that made them."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        counts = materialize(line_counts(docs, min_chars), "line-counts")
        repeated = counts.where(F.col("n_docs") >= min_docs).count()
        shards = max(1, -(-repeated // KEYS_PER_SHARD))
        return cls(counts, materialize(build_filters(counts, min_docs, shards), "line-filters"), min_docs, min_chars, shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(line_counts(docs, self.min_chars), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents inserted before; counts that reach zero leave the table."""
        return self._changed(line_counts(docs, self.min_chars), -1)

    def _changed(self, change: DataFrame, sign: int) -> LineIndex:
        old = self.counts.select("h1", "h2", F.col("n_docs").alias("old"), F.lit(0).cast("long").alias("delta"))
        new = change.select("h1", "h2", F.lit(0).cast("long").alias("old"), (F.col("n_docs") * sign).alias("delta"))
        both = materialize(
            old.unionByName(new).groupBy("h1", "h2").agg(F.sum("old").alias("old"), F.sum("delta").alias("delta")),
            "line-change",
        ).withColumn("n_docs", F.col("old") + F.col("delta"))
        counts = both.where("n_docs > 0").select("h1", "h2", "n_docs")
        shards = max(1, -(-counts.where(F.col("n_docs") >= self.min_docs).count() // KEYS_PER_SHARD))
        if shards > 2 * self.shards:  # the keys have outgrown their shards: deal them anew
            return LineIndex(counts, materialize(build_filters(counts, self.min_docs, shards), "line-filters"), self.min_docs, self.min_chars, shards)
        was, now = F.col("old") >= self.min_docs, F.col("n_docs") >= self.min_docs
        moved = both.where(was != now).select("h1", "h2", now.alias("add"), _shard(self.shards).alias("shard"))

        def update(key, held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            n = int(held["n_keys"].sum()) if len(held) else 0
            into, out = moves[moves["add"]], moves[~moves["add"]]
            made = CuckooFilter.from_bytes(held["slots"].iloc[0]) if len(held) else CuckooFilter.sized_for(len(into))
            made.remove(out["h1"].to_numpy(), out["h2"].to_numpy())
            fits = made.add(into["h1"].to_numpy(), into["h2"].to_numpy())
            blob = made.to_bytes() if fits else None
            return pd.DataFrame({"shard": [key[0]], "n_keys": [n + len(into) - len(out)], "slots": [blob]})

        filters = materialize(
            self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, FILTER_SCHEMA), "line-filters"
        )
        if filters.where("slots IS NULL").limit(1).count():  # a full shard: build it anew, larger
            filters = materialize(build_filters(counts, self.min_docs, self.shards), "line-filters")
        return LineIndex(counts, filters, self.min_docs, self.min_chars, self.shards)

    def _probe(self, blobs: dict[int, bytes]):
        shards = self.shards
        cache: dict[int, CuckooFilter] = {}

        def hits(pairs: np.ndarray) -> np.ndarray:
            out = np.zeros(len(pairs), dtype=bool)
            where = _shard_of(pairs[:, 0], shards)
            for s in np.unique(where):
                if int(s) in blobs:
                    held = cache.setdefault(int(s), CuckooFilter.from_bytes(blobs[int(s)]))
                    mine = where == s
                    out[mine] = held.holds(pairs[mine, 0], pairs[mine, 1])
            return out

        return hits

    def prune(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped): ``docs``, which the index must hold, without repeated lines."""
        rows = docs.select("doc_id", F.col("text").cast("string"))
        spark = docs.sparkSession
        total = self.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]
        if total > BROADCAST_BYTES:
            return self._prune_by_shards(rows, self._exceptions())
        blobs = spark.sparkContext.broadcast({r["shard"]: bytes(r["slots"]) for r in self.filters.collect()})

        def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = self_probe(blobs.value)
            for batch in batches:
                pairs = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                yield batch.filter(pa.array(hits(pairs)))

        self_probe = LineIndex(None, None, self.min_docs, self.min_chars, self.shards)._probe
        rare = self.counts.where(F.col("n_docs") < self.min_docs).select("h1", "h2")
        wrong = materialize(rare.mapInArrow(mistaken, "h1 long, h2 long"), "line-exceptions")
        if wrong.count() * 16 > BROADCAST_BYTES:
            return self._prune_by_shards(rows, wrong)
        except_for = spark.sparkContext.broadcast({(r["h1"], r["h2"]) for r in wrong.collect()})
        min_chars = self.min_chars

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            hits, spared = self_probe(blobs.value), except_for.value
            for batch in slices(batches):
                split = [_text_bytes(t).split(b"\n") for t in batch.column(1).to_pylist()]
                keys = [list(map(line_key, lines)) for lines in split]
                seen = [k for k in {k for ks in keys for k in ks} if k and _long_enough(k, min_chars)]
                pairs = _hashes(seen)
                gone = {k for k, hit, pair in zip(seen, hits(pairs), pairs.tolist(), strict=True) if hit and tuple(pair) not in spared}
                yield _kept_rows(batch.column(0), split, keys, [gone] * len(split))

        return rows.mapInArrow(drop, _pruned_schema(docs))

    def _dealt(self, rows: DataFrame, salts: int, spared: DataFrame | None = None) -> DataFrame:
        """The rows (k1, k2, h1, h2, salt) whose hash their shard's filter holds and that aren't in ``spared``.

        Filters and exceptions go to ``salts`` copies of each shard, rows to one. A task reads a shard's filter, its exceptions, then its rows as a stream.
        """
        none, of = F.lit(None), _shard(self.shards).alias("shard")
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        empty = [none.cast("long").alias(c) for c in ("k1", "k2")]
        met = self.filters.select("shard", copies, F.lit(0).alias("kind"), "slots", *empty, *[none.cast("long").alias(c) for c in ("h1", "h2")])
        if spared is not None:
            met = met.unionByName(spared.select(of, copies, F.lit(1).alias("kind"), none.cast("binary").alias("slots"), *empty, "h1", "h2"))
        met = met.unionByName(rows.select(of, "salt", F.lit(2).alias("kind"), none.cast("binary").alias("slots"), "k1", "k2", "h1", "h2"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held, known = None, None, set()
            for batch in batches:
                shards, salt, kinds = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
                moves = np.flatnonzero((np.diff(shards) != 0) | (np.diff(salt) != 0) | (np.diff(kinds) != 0)) + 1
                cuts = [0, *moves.tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if (shards[a], salt[a]) != here:
                        here, held, known = (shards[a], salt[a]), None, set()
                    if kinds[a] == 0:
                        held = CuckooFilter.from_bytes(part.column("slots")[0].as_py())
                        continue
                    pairs = np.column_stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()])
                    if kinds[a] == 1:
                        known.update(map(tuple, pairs.tolist()))
                    elif held is not None:
                        hit = held.holds(pairs[:, 0], pairs[:, 1])
                        if known:
                            hit[hit] = [tuple(pair) not in known for pair in pairs[hit].tolist()]
                        yield part.select(["k1", "k2", "h1", "h2"]).filter(pa.array(hit))

        return met.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(probe, "k1 long, k2 long, h1 long, h2 long")

    def _exceptions(self) -> DataFrame:
        """(h1, h2) of the keys that aren't repeated although their shard's filter says so."""
        none = F.lit(None).cast("long")
        rare = self.counts.where(F.col("n_docs") < self.min_docs).select(none.alias("k1"), none.alias("k2"), "h1", "h2", F.lit(0).alias("salt"))
        return materialize(self._dealt(rare, 1).select("h1", "h2"), "line-exceptions")

    def _prune_by_shards(self, rows: DataFrame, spared: DataFrame) -> DataFrame:
        """The way for filters or exceptions too large to broadcast: line hashes go to their shards, and hits back to their texts."""
        min_chars = self.min_chars

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                for i, text in enumerate(batch.column(0).to_pylist()):
                    keys = [k for k in set(map(line_key, _text_bytes(text).split(b"\n"))) if k and _long_enough(k, min_chars)]
                    pairs = _hashes(keys)
                    row = [pa.array([batch.column(c)[i].as_py()] * len(keys), pa.int64()) for c in (1, 2)]
                    at += 1
                    salt = pa.array([at % SALTS] * len(keys), pa.int32())
                    yield pa.RecordBatch.from_arrays([*row, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), salt], names=["k1", "k2", "h1", "h2", "salt"])

        keyed = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
        lines = keyed.select("text", "k1", "k2").mapInArrow(hashed, "k1 long, k2 long, h1 long, h2 long, salt int")
        gone = self._dealt(lines, SALTS, spared).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in slices(batches):
                split = [_text_bytes(t).split(b"\n") for t in batch.column(1).to_pylist()]
                keys = [list(map(line_key, lines)) for lines in split]
                out = []
                for ks, found in zip(keys, batch.column(2).to_pylist(), strict=True):
                    hit = {(g["h1"], g["h2"]) for g in found or ()}
                    own = list(set(ks)) if hit else []
                    out.append({k for k, pair in zip(own, _hashes(own).tolist(), strict=True) if tuple(pair) in hit})
                yield _kept_rows(batch.column(0), split, keys, out)

        return keyed.join(gone, ["k1", "k2"], "left").select("doc_id", "text", "gone").mapInArrow(drop, _pruned_schema(rows))


def _pruned_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long, kept_sha256 string"


def _kept_rows(ids: pa.Array, split: list[list[bytes]], keys: list[list[bytes]], gone: list[set[bytes]]) -> pa.RecordBatch:
    kept = [b"\n".join([x for x, k in zip(lines, ks, strict=True) if k not in g]) if g else b"\n".join(lines) for lines, ks, g in zip(split, keys, gone, strict=True)]
    dropped = [sum(k in g for k in ks) if g else 0 for ks, g in zip(keys, gone, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()),
            pa.array([len(x) for x in split], pa.int64()),
            pa.array(dropped, pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        ],
        names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"],
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Index ``docs`` and prune them: (doc_id, text, n_lines, n_dropped, kept_sha256)."""
    return LineIndex.build(docs, min_docs, min_chars).prune(docs)
