"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Spark deals the documents out; each Arrow batch is cut into the pattern's pieces. The pieces that a worker
hasn't met go to one recursive query: their token-position rows are joined with the merge table, and each piece's
leftmost pair of minimum rank is contracted, until none is left. A worker remembers up to ``MEMO`` pieces, those that it met lately,
until it gets a task of another operator. Decoding joins ids with the vocabulary and aggregates the bytes in order.

In pieces from ``LONG`` bytes all pairs of the minimum rank are contracted in a round, from the left, where they don't
overlap, up to the first whose new token makes a pair of a lower rank with a neighbour: that pair would come before the
others. So the ids are those of single contractions. Queries that outgrow DuckDB's memory, for pieces of
millions of characters, spill to the worker's own scratch folder as a shuffle would; nothing else reads it.

Edge cases. A null or empty text gives an empty list of ids, a null list of ids no bytes. Null or repeated
ids of documents are kept. An id that isn't in the vocabulary raises an error. Texts of any length are
encoded whole; a single piece (a run of letters, say) takes as many rounds as different tokens form in it.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import kept, slices

MEMO = 400_000
#: Characters of texts, bytes of pieces and ids that are worked on at once (a longer one alone), and rounds of contraction in one query.
TEXT_BLOCK, PIECE_BLOCK, ID_BLOCK, ROUNDS = 1_000_000, 500_000, 200_000, 64
#: Bytes from which a piece is long, and bytes of long pieces at once (a longer one alone) and rounds of their queries.
LONG, LONG_BLOCK, LONG_ROUNDS = 64, 50_000, 16

_CONTRACT = f"""
WITH RECURSIVE state(round, piece, ids) AS (
    SELECT 0, piece, ids FROM pieces
    UNION ALL
    SELECT round + 1, s.piece, list_concat(ids[1:p - 1], [token], ids[p + 2:])
    FROM state s JOIN (
        SELECT piece, CAST(min(pair) >> 32 AS INTEGER) AS token, CAST(min(pair) & 4294967295 AS INTEGER) AS p
        FROM (
            SELECT t.piece, (CAST(m.token AS BIGINT) << 32) + t.pos AS pair
            FROM (SELECT piece, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM state) t
            JOIN merges m ON m.first = t.a AND m.second = t.b
        )
        GROUP BY piece
    ) USING (piece)
    WHERE round < {ROUNDS}
)
SELECT piece, ids, round AS rounds FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round)
"""

# hits: the pairs of least rank; firsts: every second of a run of them; after: the ranks that a contracted pair would have with its neighbours
_CONTRACT_ALL = f"""
WITH RECURSIVE state(round, piece, ids) AS (
    SELECT 0, piece, ids FROM pieces
    UNION ALL (
        WITH tokens AS (SELECT round, piece, unnest(ids) AS a, unnest(list_append(ids[2:], NULL)) AS b, generate_subscripts(ids, 1) AS pos FROM state WHERE round < {LONG_ROUNDS}),
        pairs AS (SELECT t.piece, t.pos, m.token FROM tokens t JOIN merges m ON m.first = t.a AND m.second = t.b),
        least AS (SELECT piece, min(token) AS token FROM pairs GROUP BY piece),
        hits AS (SELECT piece, pos, token, pos - row_number() OVER (PARTITION BY piece ORDER BY pos) AS run FROM pairs SEMI JOIN least USING (piece, token)),
        firsts AS (SELECT piece, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS place FROM hits) WHERE place % 2 = 1),
        around AS (
            SELECT f.piece, f.pos, f.token, CASE WHEN g.pos IS NULL THEN l.a ELSE f.token END AS before, r.a AS after
            FROM firsts f LEFT JOIN tokens l ON l.piece = f.piece AND l.pos = f.pos - 1
            LEFT JOIN tokens r ON r.piece = f.piece AND r.pos = f.pos + 2 LEFT JOIN firsts g ON g.piece = f.piece AND g.pos = f.pos - 2
        ),
        stops AS (
            SELECT piece, min(pos) AS stop FROM around JOIN merges m ON (m.first = around.before AND m.second = around.token) WHERE m.token < around.token GROUP BY piece
            UNION ALL
            SELECT piece, min(pos) AS stop FROM around JOIN merges m ON (m.first = around.token AND m.second = around.after) WHERE m.token < around.token GROUP BY piece
        ),
        taken AS (
            SELECT f.piece, f.pos, f.token FROM firsts f LEFT JOIN (SELECT piece, min(stop) AS stop FROM stops GROUP BY piece) s ON s.piece = f.piece
            WHERE f.pos <= coalesce(s.stop, f.pos)
        )
        SELECT t.round + 1, t.piece, list(coalesce(f.token, t.a) ORDER BY t.pos)
        FROM (SELECT * FROM tokens SEMI JOIN least USING (piece)) t
        LEFT JOIN taken f ON f.piece = t.piece AND f.pos = t.pos
        ANTI JOIN taken g ON g.piece = t.piece AND g.pos + 1 = t.pos
        GROUP BY t.round, t.piece
    )
)
SELECT piece, ids, round AS rounds FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round)
"""

_DECODE = """
SELECT doc, array_to_string(list_select(bytes, list_grade_up(places)), '') AS bytes
FROM (
    SELECT doc, list(v.bytes) AS bytes, list(i.pos) AS places
    FROM (SELECT doc, unnest(ids) AS token, generate_subscripts(ids, 1) AS pos FROM encoded) i
    JOIN vocabulary v USING (token)
    GROUP BY doc
)
"""


class Codec:
    """One worker's vocabulary, DuckDB connection and memory of encoded pieces."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was remembered before; what is met again moves up
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": tempfile.mkdtemp(prefix="duckdb-")})  # its own, in the worker's scratch
        splits = [(self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        first, second, token = zip(*(s for s in splits if s[0] is not None and s[1] is not None), strict=True)
        merges = pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "token": pa.array(token, pa.int32())})  # noqa: F841
        self.tokens = pa.array(self.ranks.values(), pa.int32())
        vocabulary = pa.table({"token": self.tokens, "bytes": ["".join(chr(b or 256) for b in t) for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary")

    def _contract(self, raws: list[bytes], query: str = _CONTRACT, most: int = ROUNDS) -> list[bytes]:
        """The ids of each piece, as int32 bytes. Pieces of more than ``most`` rounds take several queries."""
        done: list[bytes] = [b""] * len(raws)
        names = np.arange(len(raws), dtype=np.int32)
        left = _lists([len(r) for r in raws], self.single[np.frombuffer(b"".join(raws), np.uint8)])
        while len(left):
            self.db.register("pieces", pa.table({"piece": names, "ids": left}))
            out = self.db.sql(query).to_arrow_table().combine_chunks()
            self.db.unregister("pieces")
            names, ids = out["piece"].to_numpy(), out["ids"].combine_chunks()
            starts, raw = ids.offsets.to_numpy() * 4, ids.values.to_numpy().tobytes()
            for name, a, b in zip(names.tolist(), starts.tolist(), starts[1:].tolist(), strict=False):
                done[name] = raw[a:b]
            names = names[out["rounds"].to_numpy() == most]
            left = _lists([len(done[name]) // 4 for name in names], np.frombuffer(b"".join(done[name] for name in names), dtype=np.int32))
        return done

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't remembered yet."""
        kinds: list[tuple[list[str], list[bytes]]] = [([], []), ([], [])]  # short and long ones
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            else:
                names, raws = kinds[len(raw) >= LONG]
                names.append(piece)
                raws.append(raw)
        for (names, raws), size, query, most in zip(kinds, (PIECE_BLOCK, LONG_BLOCK), (_CONTRACT, _CONTRACT_ALL), (ROUNDS, LONG_ROUNDS), strict=True):
            for at, end in _blocks(list(map(len, raws)), size):
                self.pieces.update(zip(names[at:end], self._contract(raws[at:end], query, most), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.pieces) > MEMO // 2:
            self.pieces, self.before = {}, self.pieces
        new = set().union(*cut) - self.pieces.keys()
        met = new & self.before.keys()
        self.pieces.update((p, self.before[p]) for p in met)
        self.learn(new - met)
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: pa.Array) -> list[bytes]:
        self.db.register("encoded", pa.table({"doc": np.arange(len(ids), dtype=np.int32), "ids": ids}))
        out = [b""] * len(ids)
        for doc, text in self.db.execute(_DECODE).fetchall():
            out[doc] = text.replace("\u0100", "\0").encode("latin-1")  # a character a byte, but for zero
        self.db.unregister("encoded")
        return out


def _lists(sizes: list[int], values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values))


def _codec(rank_file: bytes, pattern: str) -> Codec:
    return kept(Codec, rank_file, pattern)


def _blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at, end in _blocks([len(t) for t in texts], TEXT_BLOCK):
            ids = codec.encode(texts[at:end])
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>). The driver reads the rank file, of fixed size, and broadcasts it."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(_codec(ranks.value, pattern), batches)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes binary) of (doc_id, ids)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            yield from _decoded(codec, batch)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")


def _decoded(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column(1)
    known = pa.compute.is_in(ids.flatten(), codec.tokens)
    if not pa.compute.all(known, min_count=0).as_py():
        raise ValueError("an id isn't in the vocabulary")
    sizes = [n or 0 for n in pa.compute.list_value_length(ids).to_pylist()]
    for at, end in _blocks(sizes, ID_BLOCK):
        part = batch.slice(at, end - at)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(part.column(1)), pa.binary())], names=["doc_id", "ids", "bytes"])


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``decode(encode(docs))``, by one Python worker with one vocabulary a task instead of two."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in _encoded(codec, batches):
            yield from _decoded(codec, batch)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
