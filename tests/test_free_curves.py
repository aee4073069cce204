"""Curves of one's own against dense grids and the built-in curves."""

import numpy as np
from pyspark.sql import functions as F

from rimward import models
from rimward.flow import Flow, fit_correct
from rimward.free_curves import FreeCurve

TWO_RATES = FreeCurve(
    "Two Rates", "two_rates", ("a1", "b1", "a2", "b2", "level"),
    lambda d, p: p["a1"] * (1 - F.exp(-p["b1"] * d)) + p["a2"] * (1 - F.exp(-p["b2"] * d)) + p["level"],
    start=lambda: [1.0, 5.0 / (F.col("d_mean") + 1e-6), 1.0, 0.5 / (F.col("d_mean") + 1e-6), F.col("s_mean") - 1.0],
    bounds={"b1": (1e-6, 1e3), "b2": (1e-6, 1e3)}, limit=lambda p: p["a1"] + p["a2"] + p["level"],
)
SATURATION = FreeCurve(
    "Own Saturation", "own_saturation", ("a", "b", "c"), lambda d, p: p["a"] * (1 - F.exp(-p["b"] * d)) + p["c"],
    start=lambda: [0.1, 1.0 / F.col("d_mean"), F.col("s_mean")], bounds={"b": (1e-6, 1e6)}, limit=lambda p: p["a"] + p["c"],
    reached=lambda p, share: F.lit(-float(np.log(1 - 0.95))) / p["b"],
)
BROKEN = FreeCurve("Broken", "broken", ("a",), lambda d, p: F.log(-F.abs(p["a"]) - 1.0) + d, start=lambda: [1.0])


def long(spark, groups):
    rows = [("s", m, i, float(d), float(s)) for m, (ds, ss) in groups.items() for i, (d, s) in enumerate(zip(ds, ss, strict=True))]
    return spark.createDataFrame(rows, "sample_id string, measure string, node_id long, d double, S double")


def by_measure(df):
    return {r["measure"]: r for r in df.collect()}


def test_two_rates_are_fitted_per_group(spark):
    d = np.linspace(0, 10, 120)
    curve = lambda a1, b1, a2, b2, c: a1 * (1 - np.exp(-b1 * d)) + a2 * (1 - np.exp(-b2 * d)) + c
    noise = np.random.default_rng(1).normal(0, 0.01, len(d))
    made = {"exact": (d, curve(3.0, 4.0, 2.0, 0.3, 1.0)), "noisy": (d, curve(1.5, 2.5, 4.0, 0.2, 6.0) + noise)}
    fits = by_measure(models.fit_models(long(spark, made), (models.CONSTANT, TWO_RATES)).where("model = 'Two Rates'"))
    assert all(r["converged"] for r in fits.values())
    assert np.allclose(fits["exact"]["p"], [3.0, 4.0, 2.0, 0.3, 1.0], rtol=1e-3)
    assert np.isclose(fits["exact"]["plateau"], 6.0, rtol=1e-3)
    error = np.mean((made["noisy"][1] - curve(*fits["noisy"]["p"])) ** 2)
    assert error <= np.mean(noise**2) * (1 + 1e-9)  # no worse than the truth
    for i in range(5):  # and a minimum
        for sign in (-1, 1):
            p = list(fits["noisy"]["p"])
            p[i] += sign * 1e-3 * max(1, abs(p[i]))
            assert np.mean((made["noisy"][1] - curve(*p)) ** 2) >= error


def test_own_saturation_equals_the_built_in_one(spark):
    rng = np.random.default_rng(2)
    d = np.repeat(rng.uniform(0, 8, 50), 3)
    s = 4 * (1 - np.exp(-0.4 * d)) + 1 + rng.normal(0, 0.2, len(d))
    rows = long(spark, {"m": (np.append(d, [np.nan, 3.0]), np.append(s, [1.0, np.inf]))})
    fits = {r["model"]: r for r in models.fit_models(rows, (models.CONSTANT, models.EXPONENTIAL, SATURATION)).collect()}
    own, built = fits["Own Saturation"], fits["Exponential Saturation Fit"]
    assert np.allclose(own["p"], [built["m"], built["b"], built["c"]], rtol=1e-4)
    assert all(np.isclose(own[c], built[c], rtol=1e-5) for c in ("ll", "aic", "included", "affected", "effect_strength", "plateau"))
    corrected = fit_correct(rows, SATURATION)[1]
    values = [r["corrected"] for r in corrected.orderBy("node_id").collect()]
    assert np.isnan(values[-2:]).all() and np.isclose(values[0], s[0] + own["p"][0] * np.exp(-own["p"][1] * d[0]), rtol=1e-4)


def test_a_curve_that_fails_gives_nan_rows(spark):
    d = np.linspace(0, 5, 30)
    scores = spark.createDataFrame([("s", i, float(4 - 3 * np.exp(-0.8 * x))) for i, x in enumerate(d)], "sample_id string, node_id long, score double")
    distances = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(d)], "sample_id string, node_id long, d double")
    result = Flow.from_distances_and_scores(distances, scores).flow(fits=(models.CONSTANT, BROKEN, SATURATION))
    broken = result.fits.where("model = 'Broken'").first()
    assert not broken["converged"] and broken["p"] is None and np.isnan(broken["plateau"]) and broken["aic"] == np.inf
    quality = result.fit_quality.first()
    assert quality["best_fit_type"] == "Own Saturation" and set(quality["params"]) == {"a", "b", "c"}
    assert not any(np.isnan(r["corrected_score"]) for r in result.observations.collect())


def test_bounds_hold(spark):
    d = np.linspace(0, 5, 40)
    held = FreeCurve("Held", "held", ("m", "c"), lambda d, p: p["m"] * d + p["c"], start=lambda: [0.0, 0.0], bounds={"m": (-1.0, 1.0)})
    fit = models.fit_models(long(spark, {"m": (d, 3 * d + 1)}), (models.CONSTANT, held)).where("model = 'Held'").first()
    assert fit["converged"] and fit["p"][0] == 1.0 and np.isclose(fit["p"][1], np.mean(3 * d + 1 - d), atol=1e-6)
