"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A *proven* boundary lies before a space between two characters that aren't white space: the byte-level
pattern always begins a piece there, and no special token holds a space, so the tokens on either side don't
depend on the other side. Chunks of a huge text begin at proven boundaries and overlap. The next chunk is
spliced at a proven boundary of the overlap, after the tokens of both encodings from there on were found
equal, by id and offsets. Where an overlap has no such boundary or the tokens differ, it is widened, up to
the whole rest of the text. Other texts are cut at their proven boundaries, and each worker remembers the
counts of up to ``MEMO`` such units.

Edge cases. A null or empty text has 0 tokens. Null or repeated ids are kept. Special strings inside a text
count as the tokenizer takes them by default. A text without proven boundaries is encoded whole. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MEMO = 400_000
HUGE, CHUNK, OVERLAP, AGREE = 65_536, 32_768, 512, 4

UNIT = re.compile(r"(?<=\S)(?= \S)")
TWO_WHITE = re.compile(r"\s\s")


class Counter:
    """One worker's tokenizer and remembered counts."""

    def __init__(self, source: str):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {"": 0}

    def count_all(self, texts: list[str], huge: int = HUGE) -> list[int]:
        cut = [split_units(t) if len(t) < huge else None for t in texts]
        new = list({u for units in cut if units for u in units if u not in self.known})
        if len(self.known) + len(new) > MEMO:
            self.known = {"": 0}
            new = list({u for units in cut if units for u in units if u})
        self.known.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        known = self.known
        return [self.count_huge(t) if units is None else sum([known[u] for u in units]) for t, units in zip(texts, cut, strict=True)]

    def _tokens(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        got = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(got.ids, got.offsets, strict=True)]

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        total, start, end = 0, 0, min(chunk, len(text))
        tokens = self._tokens(text, start, end)
        while end < len(text):
            reach, splice = overlap, None
            while splice is None and reach < end - start:
                first = UNIT.search(text, end - reach, end)
                if first and first.start() > start:
                    stop = min(first.start() + chunk, len(text))
                    following = self._tokens(text, first.start(), stop)
                    splice = _splice(tokens, following, first.start(), end)
                reach *= 2
            if splice is None:  # nothing to align on: one chunk takes more of the text
                end = min(len(text), end + max(chunk, end - start))
                tokens = self._tokens(text, start, end)
            else:
                total, start, end, tokens = total + splice, first.start(), stop, following
        return total + len(tokens)


def _splice(before: list[tuple], after: list[tuple], boundary: int, end: int) -> int | None:
    """How many tokens of ``before`` lie before ``boundary``, if both agree from there on; the last ones may differ, where ``before`` was cut."""
    at = next((i for i, (_, _, b) in enumerate(before) if b > boundary), len(before))
    tail = before[at:]
    same = next((i for i, (x, y) in enumerate(zip(tail, after, strict=False)) if x != y), min(len(tail), len(after)))
    return at if same >= AGREE else None


def split_units(text: str) -> list[str]:
    """Cut before each space that stands between two characters that aren't white space."""
    if TWO_WHITE.search(text) or text[:1] == " " or text[-1:] == " ":
        return UNIT.split(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]


@lru_cache(maxsize=2)
def _counter(source: str) -> Counter:
    return Counter(source)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). The driver reads the tokenizer file, of fixed size, and broadcasts it."""
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counter.count_all(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
