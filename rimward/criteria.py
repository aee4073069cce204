"""Likelihood, information criterion, relative weights and their entropy, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: The least positive normal double.
TINY = 2.2250738585072014e-308


def log_likelihood(n: Column, mean_square: Column) -> Column:
    """Of normal residuals with their own variance, which is at least the least positive double."""
    return -0.5 * n * (F.log(2 * math.pi * F.greatest(mean_square, F.lit(TINY))) + 1)


def akaike(n_params: Column | int, ll: Column) -> Column:
    return 2.0 * n_params - 2.0 * ll


def relative_likelihood(aic: Column, baseline: Column, n: Column) -> Column:
    """exp((baseline - aic) / 2n); 0 for a failed fit."""
    return F.when(aic == float("inf"), F.lit(0.0)).otherwise(F.exp((baseline - aic) / (2.0 * n)))


def weight_entropy(weight: Column, count: Column, over: WindowSpec | None = None) -> Column:
    """Normalised entropy of ``weight``, shares that sum to 1, as an aggregate or over a window; 0 for one or none. Null weights count for nothing."""
    total = F.sum(-weight * F.log(weight + 1e-15))
    total = total if over is None else total.over(over)
    return F.when(count <= 1, F.lit(0.0)).otherwise(total / F.nullif(F.log(count), F.lit(0.0)))
