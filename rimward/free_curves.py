"""Curves with any number of parameters, fitted by damped least squares whose normal equations are sums.

A pass takes, for every group at once, the squared error and the normal equations at some trial parameters of each group, as sums over its distinct
distances. A small table of groups then moves on: the best trial is taken if it lowers the error, and the next trials solve the equations under
three dampings, clipped to the bounds. A group has converged once no trial changes the error or the parameters any more. Slopes are central
differences. No group's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.storage import dropped, stored

KEYS = ["sample_id", "measure"]
#: Passes at most; dampings tried beside the last one; a relative change that is none; the rounding of squared errors, as a share of the squares of S.
MOST_PASSES, DAMPINGS, NO_CHANGE, ROUNDING = 100, (0.01, 1.0, 100.0), 1e-10, 1e-10

Params = Mapping[str, Column]


@dataclass(frozen=True)
class FreeCurve:
    """A curve S = curve(d, params) of one's own.

    ``start`` gives the first parameters, over the statistics of a group (n, d_min, d_max, d_mean, d_least, s_mean). ``bounds`` hold by name. ``limit`` is the level far from the border,
    where it isn't that at the largest distance; ``half`` the d at which the curve reaches y, and ``reached`` that of a share of saturation, where they are known.
    """

    name: str
    key: str
    params: tuple[str, ...]
    curve: Callable[[Column, Params], Column]
    start: Callable[[], Sequence[Column | float]]
    bounds: Mapping[str, tuple[float, float]] | None = None
    limit: Callable[[Params], Column] | None = None
    half: Callable[[Column, Params], Column] | None = None
    reached: Callable[[Params, float], Column] | None = None

    @property
    def n_params(self) -> int:
        return len(self.params)

    def at(self, d: Column, values: Column) -> Column:
        """The curve at d with the parameters in an array."""
        return self.curve(d, self.named(values))

    def named(self, values: Column) -> dict[str, Column]:
        return {name: F.get(values, F.lit(i)) for i, name in enumerate(self.params)}

    def limits(self) -> tuple[list[float], list[float]]:
        held = [(self.bounds or {}).get(name, (-np.inf, np.inf)) for name in self.params]
        return [float(low) for low, _ in held], [float(high) for _, high in held]


def _equations(curve: FreeCurve, points: DataFrame, state: DataFrame) -> DataFrame:
    """(keys, trial, e, g, h) of each trial: squared error, and the sums of slopes times residuals and of products of slopes."""
    k = curve.n_params
    rows = points.join(state.select(*KEYS, "s_mean", F.posexplode("trials").alias("trial", "at")), KEYS)
    step = [1e-6 * F.greatest(F.abs(F.get("at", F.lit(i))), F.lit(1e-3)) for i in range(k)]
    moved = lambda i, sign: F.array(*[F.get("at", F.lit(j)) + (sign * step[j] if i == j else 0.0) for j in range(k)])
    slopes = [(curve.at(F.col("d"), moved(i, 1)) - curve.at(F.col("d"), moved(i, -1))) / (2 * step[i]) for i in range(k)]
    rows = rows.select(*KEYS, "trial", "n_d", "s1", "s2", (curve.at(F.col("d"), F.col("at")) - F.col("s_mean")).alias("f"), *[x.alias(f"j{i}") for i, x in enumerate(slopes)])
    rest = F.col("s1") - F.col("n_d") * F.col("f")
    error = F.sum(F.col("s2") - 2 * F.col("f") * F.col("s1") + F.col("n_d") * F.col("f") * F.col("f"))
    g = F.array(*[F.sum(F.col(f"j{i}") * rest) for i in range(k)])
    h = F.array(*[F.sum(F.col("n_d") * F.col(f"j{i}") * F.col(f"j{j}")) for i in range(k) for j in range(k)])
    sums = rows.groupBy(*KEYS, "trial").agg(error.alias("e"), F.sum("s2").alias("s2"), g.alias("g"), h.alias("h"))
    return sums.groupBy(*KEYS).agg(F.max("s2").alias("spread"), F.sort_array(F.collect_list(F.struct("trial", "e", "g", "h"))).alias("found"))  # as many as dampings


def _moves(curve: FreeCurve):
    """A group's next trials from what was found at its last ones."""
    low, high = (np.array(x) for x in curve.limits())
    k = curve.n_params

    def one(row: pd.Series) -> tuple:
        trials, error, damping = row["trials"], row["error"], row["damping"]
        found = [x for x in (row["found"] if row["found"] is not None else []) if x["e"] is not None and np.isfinite(x["e"]) and np.isfinite(np.array([*x["g"], *x["h"]], dtype=float)).all()]
        best = min(found, key=lambda x: (x["e"], x["trial"]), default=None)
        first = row["p"] is None
        if first and best is None:
            return trials[0], [], np.nan, damping, [], [], True, False
        if first or (best is not None and best["e"] < error):
            p, g, h = (np.array(x, dtype=float) for x in (trials[best["trial"]], best["g"], best["h"]))
            moved = np.inf if first else np.abs(p - np.array(row["p"], dtype=float)).max() / max(1e-12, np.abs(p).max())
            gain = np.inf if first else (error - best["e"]) / (error + ROUNDING * row["spread"] + 1e-300)
            damping = damping if first else max(1e-12, damping * DAMPINGS[best["trial"]])
            rests, error = bool(gain < NO_CHANGE or moved < NO_CHANGE), max(best["e"], 0.0)
        else:
            p, g, h = (np.array(row[c], dtype=float) for c in ("p", "g", "h"))
            damping, rests = damping * 1e3, damping > 1e9  # nothing near is better: a minimum, as far as doubles tell
        products = h.reshape(k, k)
        scale = np.maximum(np.diag(products), 1e-300)
        # a parameter at a bound that would go beyond it stays there
        free = ~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0)))
        following = []
        for share in DAMPINGS:
            step = np.zeros(k)
            step[free] = np.linalg.lstsq((products + damping * share * np.diag(scale))[np.ix_(free, free)], g[free], rcond=None)[0]
            following.append(np.clip(p + step, low, high).tolist())
        still = all(np.abs(np.array(t) - p).max() <= NO_CHANGE * max(1e-12, np.abs(p).max()) for t in following)
        return p.tolist(), following, float(error), float(damping), g.tolist(), h.tolist(), bool(rests or still), True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = [one(row) for _, row in frame.iterrows()]
            out = frame[[*KEYS, "s_mean"]].copy()
            for i, name in enumerate(("p", "trials", "error", "damping", "g", "h", "done", "able")):
                out[name] = pd.Series([x[i] for x in new], index=frame.index, dtype=None if name in ("error", "damping", "done", "able") else object)
            yield out

    return run


def fit_free(curve: FreeCurve, points: DataFrame, statistics: DataFrame) -> DataFrame:
    """(keys, p, converged) of every group with included rows; p is the array of parameters. A group whose error isn't finite hasn't converged.

    points: (keys, d, n_d, s1, s2), the included rows summed by distance with S less the group's mean ``s_mean``.
    """
    fields = ", ".join(f"{k} string" for k in KEYS) + ", s_mean double, p array<double>, trials array<array<double>>, error double, damping double, g array<double>, h array<double>, done boolean, able boolean"
    first = F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in curve.start()])
    none = F.lit(None).cast("array<double>")
    state = statistics.where("n > 0").select(
        *KEYS, "s_mean", none.alias("p"), F.array(first).alias("trials"), F.lit(float("inf")).alias("error"), F.lit(1e-3).alias("damping"), none.alias("g"), none.alias("h"), F.lit(False).alias("done"), F.lit(True).alias("able")
    )
    state, finished = stored(state, "curves"), []
    for _ in range(MOST_PASSES):
        met = state.join(_equations(curve, points, state), KEYS, "left")
        new = stored(met.mapInPandas(_moves(curve), fields), "curves")
        dropped(state)
        finished.append(new.where("done").select(*KEYS, "p", F.col("able").alias("converged")))
        state = new.where("NOT done")
        if state.isEmpty():
            break
    out = state.select(*KEYS, "p", F.lit(False).alias("converged"))
    for part in finished:
        out = out.unionByName(part)
    return out
