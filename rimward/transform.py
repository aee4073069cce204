"""Exact distances to the nearest True pixel of dense masks, an axis at a time.

The first pass takes each line along the last axis by itself: how far every pixel of the line is from the line's nearest True pixel. Each further
pass takes the lines across, where the squared distance is the least of parabolas, one from each pixel of the line, and their lower envelope gives
all minima in one sweep. Lines travel in blocks of ``BLOCK`` neighbours, so a task holds ``BLOCK`` lines of one axis at a time, and
rows are as many as the mask has pixels over ``BLOCK``, however many of them are True.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that travel together.
BLOCK = 64


def lower_envelope(at: np.ndarray, heights: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The least of (x - at[r])² + heights[r] over r, for every x of ``asked`` and every column of ``heights``. ``at`` and ``asked`` ascend."""
    n, columns = heights.shape
    each = np.arange(columns)
    held, begins, top = np.zeros((n, columns), dtype=int), np.full((n + 1, columns), np.inf), np.zeros(columns, dtype=int)
    begins[0] = -np.inf
    lifted = heights + (at**2)[:, None]
    for r in range(1, n):
        left = each
        while len(left):
            last = held[top[left], left]
            meet = (lifted[r, left] - lifted[last, left]) / (2.0 * (at[r] - at[last]))
            hides = meet <= begins[top[left], left]
            stays = left[~hides]
            top[stays] += 1
            held[top[stays], stays], begins[top[stays], stays] = r, meet[~hides]
            left = left[hides]
            top[left] -= 1
    begins[np.arange(n + 1)[:, None] > top] = np.inf
    out, place = np.empty((len(asked), columns)), np.zeros(columns, dtype=int)
    for row, x in enumerate(asked):
        while (behind := begins[place + 1, each] < x).any():
            place += behind
        out[row] = (x - at[held[place, each]]) ** 2 + heights[held[place, each], each]
    return out


def mask_gaps(cells: DataFrame, mask: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """``cells`` (distinct pixels i, j[, k][, sample_id], all long) with ``square``, the squared distance to the nearest True pixel of ``mask`` (the same columns).

    Pixels must lie within ``shape``. Cells of a sample whose mask has no pixel give no row.
    """
    names = ["i", "j", "k"][: len(shape)]
    of = [c for c in mask.columns if c == "sample_id"]
    first, middle, last = names[0], names[1:-1], names[-1]
    kinds = {"sample_id": "string"} | dict.fromkeys([*names, "block"], "long")
    schema = lambda columns: ", ".join(f"{c} {kinds[c]}" for c in columns)
    width, depth = shape[-1], shape[1]

    def along(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        on, x = np.unique(rows[last].to_numpy()), np.arange(width)
        after = np.searchsorted(on, x)
        gap = np.minimum(np.abs(x - on[np.maximum(after - 1, 0)]), np.abs(on[np.minimum(after, len(on) - 1)] - x))
        parts = np.split((gap.astype(float)) ** 2, np.arange(BLOCK, width, BLOCK))
        frame = pd.DataFrame({c: [v] * len(parts) for c, v in zip([*of, *names[:-1]], key, strict=True)})
        return frame.assign(block=np.arange(len(parts)), squares=[p.tolist() for p in parts])

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("j")
        found = lower_envelope(rows["j"].to_numpy(), np.stack(rows["squares"].to_list()), np.arange(depth))
        frame = pd.DataFrame({c: [v] * depth for c, v in zip([*of, first, "block"], key, strict=True)})
        return frame.assign(j=np.arange(depth), squares=[f.tolist() for f in found])[[*of, first, "j", "block", "squares"]]

    def answered(lines: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(asked):
            return asked.iloc[:0][[*of, *names]].assign(square=np.zeros(0))
        lines = lines.sort_values(first)
        x, row = np.unique(asked[first].to_numpy(), return_inverse=True)
        found = lower_envelope(lines[first].to_numpy(), np.stack(lines["squares"].to_list()), x)
        return asked[[*of, *names]].assign(square=found[row, asked[last].to_numpy() % BLOCK])

    blocked = cells.withColumn("block", F.floor(F.col(last) / BLOCK))
    lines = mask.groupBy(*of, *names[:-1]).applyInPandas(along, schema([*of, *names[:-1], "block"]) + ", squares array<double>")
    # only blocks in which a cell lies go on
    lines = lines.join(blocked.select(*of, "block").distinct(), [*of, "block"], "left_semi")
    if middle:
        lines = lines.groupBy(*of, first, "block").applyInPandas(across, schema([*of, first, "j", "block"]) + ", squares array<double>")
    keys = [*of, *middle, "block"]
    return lines.groupBy(*keys).cogroup(blocked.groupBy(*keys)).applyInPandas(answered, schema([*of, *names]) + ", square double")
