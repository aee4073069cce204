"""One fit as a read-only object on the driver, for looking at a sample's few fits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rimward.free_curves import FreeCurve
from rimward.models import CONSTANT, CurveModel
from rimward.schema import ONE_SAMPLE

#: Attributes and the columns of a fit row that they are read from.
COLUMNS = {
    "aic": "aic", "log_likelihood": "ll", "effect_strength": "effect_strength", "half_life": "half_life", "plateau": "plateau", "included": "included",
    "affected": "affected", "relative_likelihood": "relative_likelihood", "entropy": "entropy", "n_rows": "n_all",
}


@dataclass(frozen=True, repr=False)
class FitReport:
    """A model's fit of a measure in a sample. ``status`` is "converged", or "failed" if the model found no parameters, which are NaN then.
    A baseline has no ``relative_likelihood`` and no ``entropy``: None.
    """

    sample_id: str
    measure: str
    model: str
    status: str
    is_best: bool
    params: Mapping[str, float]
    n_rows: int
    aic: float
    log_likelihood: float
    effect_strength: float
    half_life: float
    plateau: float
    included: float
    affected: float
    relative_likelihood: float | None
    entropy: float | None

    def __repr__(self) -> str:
        values = " ".join(f"{name}={value:.4g}" for name, value in self.params.items())
        aic = f"{self.aic:.2f}" if math.isfinite(self.aic) else "none"
        mark = " best" if self.is_best else ""
        return f"<{self.model} of {self.measure} in {self.sample_id}: {self.status}{mark}, {self.included:.1%} of {self.n_rows} rows, AIC {aic}, {values}>"

    def summary(self) -> dict[str, Any]:
        """What a row of the quality report holds, with the parameters by name beside it."""
        shown = {
            "best_fit_type": self.model, "entropy_AIC_weights": self.entropy, "observed_half_life": self.half_life, "observed_effect_strength": self.effect_strength,
            "included samples": self.included, "affected samples": self.affected, "scaled_relative_likelihood_over_baseline": self.relative_likelihood,
        }
        return shown | dict(self.params)

    @classmethod
    def of(cls, row: Row, model: CurveModel | FreeCurve) -> FitReport:
        """The report of a ranked fit row."""
        if isinstance(model, FreeCurve):
            found = dict(zip(model.params, row["p"] or [math.nan] * model.n_params, strict=True))
        elif model.key == CONSTANT.key:
            found = {model.params[2]: row["c"]}
        else:
            found = {name: row[column] for column, name in zip("bmc", model.params, strict=True)}
        status = "converged" if row["converged"] else "failed"
        return cls(
            sample_id=row["sample_id"], measure=row["measure"], model=row["model"], status=status, is_best=row["is_best"],
            params=MappingProxyType({k: math.nan if v is None else v for k, v in found.items()}), **{name: row[column] for name, column in COLUMNS.items()},
        )


def fit_reports(fits: DataFrame, models: Sequence[CurveModel | FreeCurve], measure: str, sample_id: str | None = None) -> list[FitReport]:
    """The fits of one measure in one sample (without a name, that of tables without samples), the best first: as many rows as models reach the driver."""
    sample = ONE_SAMPLE if sample_id is None else sample_id
    rows = fits.where((F.col("measure") == measure) & (F.col("sample_id") == sample)).orderBy(~F.col("is_best"), "aic", "model_ord").collect()
    if not rows:
        raise ValueError(f"There are no fits of {measure!r} in sample {sample!r}.")
    named = {model.name: model for model in models}
    return [FitReport.of(row, named[row["model"]]) for row in rows]
