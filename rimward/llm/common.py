"""What the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from rimward.storage import stored as materialize

__all__ = ["ascii_lower", "forget", "kept", "materialize", "slices", "text_or_empty"]

_kept: dict[tuple, object] = {}


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z alone. Pure ASCII text takes Spark's fast ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept(make: Callable, *args):
    """``make(*args)``, kept by this Python worker for its next tasks. It keeps one such thing: another takes its place."""
    key = (make, *args)
    if key not in _kept:
        forget()
        _kept[key] = make(*args)
    return _kept[key]


def forget() -> None:
    """Free what this Python worker keeps for another operator, and return the memory to the system.

    Spark gives a worker to stage after stage, so a vocabulary and its remembered pieces would lie beside all that later stages need.
    """
    if not _kept:
        return
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)
