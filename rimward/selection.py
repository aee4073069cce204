"""Choosing among fitted curves by information criterion, relative weights and their entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.criteria import akaike, log_likelihood, relative_likelihood, weight_entropy
from rimward.models import CONSTANT, KEYS, CurveModel

#: Decimals of an AIC that count in the choice.
AIC_DIGITS = 6

__all__ = ["akaike", "log_likelihood", "ranked_fits", "relative_likelihood", "weight_entropy"]


def ranked_fits(fits: DataFrame, baseline: CurveModel = CONSTANT) -> DataFrame:
    """``fits`` with relative_likelihood, entropy and is_best: the least AIC, of ties the earliest model, the baseline last.
    AICs tie if they agree to ``AIC_DIGITS`` decimals: two curves may fit alike but for rounding.

    Weights are over the other models; where all of them failed, the entropy is NaN. The baseline has neither.
    """
    group = Window.partitionBy(*KEYS)
    is_base = F.col("model") == baseline.name
    rows = fits.withColumn("base_aic", F.max(F.when(is_base, F.col("aic"))).over(group))
    rows = rows.withColumn("relative_likelihood", F.when(~is_base, relative_likelihood(F.col("aic"), F.col("base_aic"), F.col("n_all"))))
    rows = rows.withColumns({"total": F.sum("relative_likelihood").over(group), "others": F.sum((~is_base).cast("int")).over(group)})
    weight = F.when(~is_base, F.coalesce(F.try_divide(F.col("relative_likelihood"), F.col("total")), F.lit(float("nan"))))
    entropy = weight_entropy(weight, F.col("others"), group)
    order = group.orderBy(F.round("aic", AIC_DIGITS), "model_ord")
    return rows.withColumn("entropy", F.when(~is_base, entropy)).withColumn("is_best", F.row_number().over(order) == 1).drop("total", "others", "base_aic")
