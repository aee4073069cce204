"""Where the tokens of two tokenizers, byte-level BPE (A) and SentencePiece (B), end together, and which tokens end together how often.

The ends of a text's tokens are the bits of packed words, a bit for each byte of text. AND gives the shared cuts; the number of
set bits up to a cut, in A's words and in B's, is the rank of the token that ends there, so cuts select token ranges, the groups. Each cut links
the A token and the B token that end at it; tokens have a byte at least, so a cut makes one link.

A cut before a space between two characters that aren't white space is *proven*: A's pattern begins a piece there, and no piece of
B's vocabulary holds a space after another character, so neither tokenizer looks across it. Texts are encoded by the units between proven
cuts, and each worker remembers what some ``MEMO`` units gave. Where B's vocabulary has such a piece, texts are encoded whole.

Counts of id pairs are over all texts. Texts are dealt to blocks of about ``BLOCK_LINKS`` links in the order in which tasks read
them. Each block asks for the counts of its distinct pairs, so what is shuffled is the pairs of blocks, not links.

Edge cases. Null and empty texts have no tokens, nor have texts that the tokens of A or B don't give back byte for byte after the space, such as
those that hold U+2581: all their numbers are 0 and their groups empty. Strings of special tokens are plain text. Very long texts are
aligned piece by piece; a huge unit is encoded whole. Null ids and repeated rows are rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import materialize, text_or_empty
from rimward.llm.token_counts import split_units

#: A unit between proven cuts.
PLAIN = re.compile(r"(?s) (?=\S)[^▁]*(?<=\S)$(?!\n)")
#: Remembered units and their characters, beyond which all are forgotten; links in a block; characters of groups in an Arrow batch.
MEMO, MEMO_CHARS, BLOCK_LINKS, BATCH_CHARS = 400_000, 16_000_000, 500_000, 16_000_000
_LOW = (1 << 32) - 1


def end_bits(ends: np.ndarray, size: int) -> np.ndarray:
    """Packed words with a bit for each byte of the text, set where a token ends."""
    marks = np.zeros((size // 64 + 1) * 64, dtype=bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def shared_ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte at which both have a token's end, how many tokens of each end up to it."""
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    word, upto = cuts >> 6, np.uint64(2**64 - 1) >> (63 - (cuts & 63)).astype(np.uint64)
    return tuple((np.cumsum(np.bitwise_count(x), dtype=np.int64) - np.bitwise_count(x))[word] + np.bitwise_count(x[word] & upto) for x in (a, b))  # type: ignore[return-value]


@dataclass
class Aligned:
    """Aligned units: tokens of A and B and links of each, -1 links where its tokens don't give a unit back; groups as text; and all links as packed id pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    links: np.ndarray

    @classmethod
    def of(cls, parts: list[Aligned]) -> Aligned:
        arrays = [np.concatenate([np.zeros(0, np.int64), *[getattr(p, name) for p in parts]]) for name in ("n_a", "n_b", "n_links", "links")]
        return cls(*arrays[:3], list(chain.from_iterable(p.groups for p in parts)), arrays[3])


class Aligner:
    """One worker's two tokenizers and the units it remembers."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = {rank: token for token, rank in merges.items()}
        self.bytes_a = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b)]
        #: an id's text within a group, and at the end of its side of the group
        self.within, self.last_a, self.last_b = (np.array([f"{i}{mark}" for i in range(max(map(len, self.sizes)))], dtype=object) for mark in ",|;")
        self.by_units = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.known = Aligned.of([])
        self.starts = np.zeros(0, np.int64)

    def align(self, units: list[str]) -> Aligned:
        """The units encoded as one text; where that isn't given back, each half of them."""
        text = "".join(units)
        whole = text.encode()
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:])
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            if len(units) > 1:
                half = len(units) // 2
                return Aligned.of([self.align(units[:half]), self.align(units[half:])])
            return Aligned(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), [""], np.zeros(0, np.int64))
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = (np.cumsum(size[x]) for size, x in zip(self.sizes, (a, b), strict=True))
        rank_a, rank_b = shared_ranks(end_bits(ends_a, len(whole)), end_bits(ends_b, len(whole)))
        # the tokens of each group in order: those of A, then those of B
        first_a, first_b = np.concatenate([[0], rank_a[:-1]]), np.concatenate([[0], rank_b[:-1]])
        words = np.empty(len(a) + len(b), dtype=object)
        words[np.arange(len(a)) + np.repeat(first_b, rank_a - first_a)] = self.within[a]
        words[np.arange(len(b)) + np.repeat(rank_a, rank_b - first_b)] = self.within[b]
        words[rank_a - 1 + first_b] = self.last_a[a[rank_a - 1]]
        words[rank_b - 1 + rank_a] = self.last_b[b[rank_b - 1]]
        told = words.tolist()
        sizes = np.array(list(map(len, units)) if len(whole) == len(text) else [len(u.encode()) for u in units])
        stops = np.searchsorted(ends_a[rank_a - 1], np.cumsum(sizes), side="right")
        upto_a, upto_b = rank_a[stops - 1], rank_b[stops - 1]
        upto = (upto_a + upto_b).tolist()
        groups = ["".join(told[i:j])[:-1] for i, j in zip([0, *upto], upto, strict=False)]
        return Aligned(np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), np.diff(stops, prepend=0), groups, a[rank_a - 1] << 32 | b[rank_b - 1])

    def remember(self, units: list[str]) -> None:
        """Align units. Those between proven cuts make one text; others, at a text's ends or with U+2581, which B's bytes lose, are texts of their own."""
        plain = [u for u in units if PLAIN.match(u)] if self.by_units else []
        joined = set(plain)
        rest = [u for u in units if u not in joined]
        made = Aligned.of([*([self.align(plain)] if plain else []), *[self.align([u]) for u in rest]])
        self.place.update(zip([*plain, *rest], range(len(self.place), len(self.place) + len(units)), strict=True))
        self.chars += sum(map(len, units))
        self.known = Aligned.of([self.known, made])
        self.starts = np.cumsum(np.maximum(self.known.n_links, 0)) - np.maximum(self.known.n_links, 0)

    def units(self, text: str) -> list[str]:
        return split_units(" " + text) if self.by_units else [" " + text]

    def align_all(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """(n_a, n_b, groups, links) of each text."""
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.place) > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        place = self.place
        if fresh := {u for units in cut for u in units if u not in place}:
            self.remember(list(fresh))
        known, groups = self.known, self.known.groups
        for units in cut:
            named = [place[u] for u in units]
            at = np.array(named, dtype=np.int64)
            n = known.n_links[at]
            if not named or n.min() < 0:
                yield 0, 0, "", np.zeros(0, np.int64)
                continue
            links = known.links[np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield int(known.n_a[at].sum()), int(known.n_b[at].sum()), ";".join([groups[i] for i in named]), links


@lru_cache(maxsize=1)
def _aligner(ranks: bytes, pattern: str, model: bytes) -> Aligner:
    return Aligner(ranks, pattern, model)


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, block, pairs, times) per row.

    ``groups`` has the ids of each group in order, ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct linked ids as a << 32 | b, ``times`` the number of
    links of each. The driver reads the tokenizers' files, of fixed size, and broadcasts them.
    """
    context = docs.sparkSession.sparkContext
    files = context.broadcast((Path(ranks_path).read_bytes(), pattern, Path(model_path).read_bytes()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple] = []
                first, chars = 0, 0
                for i, (n_a, n_b, groups, links) in enumerate(aligner.align_all(part.column(1).to_pylist())):
                    pairs, times = np.unique(links, return_counts=True)
                    rows.append((n_a, n_b, len(links), groups, block, pairs, times.astype(np.int32)))
                    held, chars = held + len(links), chars + len(groups)
                    if held >= BLOCK_LINKS:
                        block, held = block + 1, 0
                    if chars >= BATCH_CHARS:
                        yield _records(part.column(0).slice(first, len(rows)), rows)
                        rows, first, chars = [], i + 1, 0
                if rows:
                    yield _records(part.column(0).slice(first, len(rows)), rows)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, block long, pairs array<long>, times array<int>")


def _records(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n_a, n_b, n_groups, groups, block, pairs, times = zip(*rows, strict=True)
    starts = pa.array([0, *accumulate(map(len, pairs))], pa.int32())
    lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in (pairs, times)]
    numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
    return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(groups, pa.string()), pa.array(block, pa.int64()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "block", "pairs", "times"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair over all rows of ``align``; best if no other A id is linked with its B id more often."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_LOW))))  # A's vocabulary at most
    return each.select("pair", "n", (F.col("n") == highest).alias("best"))


def link_totals(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of a stored table of ``align`` with n_best, links whose pair is best, and count_sum, their pairs' counts summed; without block, pairs and times."""
    asked = aligned.select("block", F.explode("pairs").alias("pair")).distinct()
    told = asked.join(counts, "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    keep = [c for c in aligned.columns if c not in ("block", "pairs", "times")]
    fields = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in keep) + ", n_best long, count_sum long"

    def total(rows: pa.Table, told: pa.Table) -> pa.Table:
        pair, n, best = (told.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order]
        pairs, times = (rows.column(c).combine_chunks() for c in ("pairs", "times"))
        sizes = np.diff(pairs.offsets.to_numpy())
        at, weight = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((weight * best[at], weight * n[at]) if len(at) else ([], []))]
        best_links, counted = (pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums)
        return rows.select(keep).append_column("n_best", best_links).append_column("count_sum", counted)

    return aligned.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(total, fields)


def token_alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, keep_groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, groups_sha256, n_best, count_sum) per row. Without ``keep_groups`` only the hash of the groups is stored; it is empty for rows without tokens."""
    found = align(docs, ranks_path, pattern, model_path)
    found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")))
    aligned = materialize(found if keep_groups else found.drop("groups"), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")
    return link_totals(aligned, counts)
