import math

import numpy as np
import pytest

from rimward import models as mo
from rimward import selection as se

D = np.linspace(0, 10, 300)
NOISE = np.random.default_rng(42).normal(0, 0.01, 300)


def fit(spark, d, s, *models, **kw):
    rows = [("all", "m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(d, s, strict=True))]
    df = spark.createDataFrame(rows, "sample_id string, measure string, node_id long, d double, S double")
    fits = mo.fit_models(df, models or mo.DEFAULT_MODELS, **kw)
    return {r["model"]: r for r in se.ranked_fits(fits, kw.get("baseline", mo.CONSTANT)).collect()}


def test_piecewise_recovers_its_knot(spark):
    r = fit(spark, D, np.where(D <= 4, 1.5 * D + 0.5, 6.5) + NOISE, mo.CONSTANT, mo.PIECEWISE)["Piecewise Linear Fit"]
    assert r["b"] == pytest.approx(4, rel=0.05) and r["m"] == pytest.approx(1.5, rel=0.05) and r["c"] == pytest.approx(0.5, abs=0.1)
    assert r["effect_strength"] < 0 and r["affected"] == pytest.approx(np.mean(D <= r["b"])) and r["is_best"]


def test_piecewise_is_no_worse_than_a_fine_grid(spark):
    s = np.sin(D) + NOISE
    r = fit(spark, D, s, mo.CONSTANT, mo.PIECEWISE)["Piecewise Linear Fit"]
    errors = []
    for b in np.linspace(0.01, 10, 2000):
        x = np.minimum(D, b)
        m, c = np.polyfit(x, s, 1)
        errors.append(np.mean((s - m * x - c) ** 2))
    ll = -150 * (math.log(2 * math.pi * min(errors)) + 1)
    assert r["ll"] >= ll - 1e-6


def test_ranges_hold_alike_many_distances_wherever_they_lie(spark):
    d = np.append(np.random.default_rng(26).uniform(0, 1, 20_000), 1e9)
    points = spark.createDataFrame([("all", "m", float(x)) for x in d], "sample_id string, measure string, d double")
    got = mo.in_ranges(points).toPandas()
    assert got.groupby("bucket").size().max() <= 4 * len(d) / mo.COARSE**2 and len(got) == len(d)
    by_d = got.sort_values("d")["bucket"]
    assert by_d.is_monotonic_increasing and by_d.min() >= 0 and by_d.max() < mo.COARSE**2


def test_an_outlying_distance_leaves_the_knot_exact(spark):
    d = np.append(np.random.default_rng(27).uniform(0, 1, 3_000), 1e9)
    s = np.where(d <= 0.4, 2 * d, 0.8) + 0.01 * np.sin(1e4 * np.minimum(d, 1))
    r = fit(spark, d, s, mo.CONSTANT, mo.PIECEWISE)["Piecewise Linear Fit"]
    least = min(np.mean((s - np.polyval(np.polyfit(x, s, 1), x)) ** 2) for x in (np.minimum(d, b) for b in np.linspace(0.01, 1, 800)))
    assert r["b"] == pytest.approx(0.4, abs=0.02) and r["ll"] >= -0.5 * len(d) * (math.log(2 * math.pi * least) + 1) - 1e-6


def test_knot_beyond_the_data(spark):
    d = np.linspace(0, 2, 300)
    assert fit(spark, d, 1.5 * d + NOISE, mo.CONSTANT, mo.PIECEWISE)["Piecewise Linear Fit"]["affected"] == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize(("model", "curve", "want"), [
    (mo.EXPONENTIAL, lambda d: 4 * (1 - np.exp(-0.3 * d)) + 0.5, (0.3, 4, 0.5)),
    (mo.MICHAELIS, lambda d: 5 * d / (3 + d) + 0.5, (3, 5, 0.5)),
])
def test_saturating_curves_recover_their_parameters(spark, model, curve, want):
    r = fit(spark, D, curve(D) + NOISE, mo.CONSTANT, model)[model.name]
    assert r["b"] == pytest.approx(want[0], rel=0.05) and r["m"] == pytest.approx(want[1], rel=0.05) and r["c"] == pytest.approx(want[2], abs=0.1)
    assert r["plateau"] == pytest.approx(r["m"] + r["c"])


@pytest.mark.parametrize("model", [mo.EXPONENTIAL, mo.MICHAELIS])
@pytest.mark.parametrize("curve", [lambda d: np.sin(d), lambda d: 1 / (1 + d), lambda d: np.sqrt(d), lambda d: np.where(d > 6, 2.0, 0.0)])
def test_saturating_fits_are_no_worse_than_a_dense_grid(spark, model, curve):
    s = curve(D) + NOISE
    r = fit(spark, D, s, mo.CONSTANT, model)[model.name]
    errors = []
    for b in np.exp(np.linspace(math.log(1e-6), math.log(1e4 if model is mo.MICHAELIS else 50 / D[1]), 4000)):
        x = 1 - np.exp(-b * D) if model is mo.EXPONENTIAL else D / (b + D)
        x = np.stack([x - x.mean(), np.ones(300)], axis=1)
        errors.append(np.mean((s - x @ np.linalg.lstsq(x, s, rcond=None)[0]) ** 2))
    assert r["ll"] >= -150 * (math.log(2 * math.pi * min(errors)) + 1) - 1e-3


def test_entropy_over_several_models(spark):
    got = fit(spark, D, np.log1p(D) + 3 * NOISE)
    weights = np.array([math.exp((got["Constant Fit"]["aic"] - r["aic"]) / 600) for m, r in got.items() if m != "Constant Fit"])
    share = weights / weights.sum()
    want = -(share * np.log(share + 1e-15)).sum() / math.log(3)
    assert 0 < want < 1 and all(r["entropy"] == pytest.approx(want) and r["relative_likelihood"] == pytest.approx(math.exp((got["Constant Fit"]["aic"] - r["aic"]) / 600)) for m, r in got.items() if m != "Constant Fit")


@pytest.mark.parametrize(("d", "fits"), [([0.0, 0.0, 1.0], False), ([0.0, 0.0, 1.0, 2.0], True), ([0.0, 0.0, 1.5e-6, 1.6e-6], False), ([0.0, 1e-6, 3.0], True), ([0.0, 1.0, 2.0], True)])
def test_the_median_decides_whether_a_hyperbola_is_tried(spark, d, fits):
    assert fit(spark, d, [1.0, 2.0, 4.0, 3.0][: len(d)], mo.CONSTANT, mo.MICHAELIS)["Michaelis-Menten Fit"]["converged"] == fits == (np.median(d) >= mo.B_MIN)


def test_saturation_metrics(spark):
    r = fit(spark, D, 5 * D / (2 + D), mo.CONSTANT, mo.MICHAELIS)["Michaelis-Menten Fit"]
    assert r["half_life"] == pytest.approx((2 * 2.5 * (10 / 12) / (5 - 2.5 * (10 / 12))) / 10, rel=1e-3)
    assert r["affected"] == pytest.approx(np.mean(r["b"] * 19 > D))
    r = fit(spark, D, 5 * (1 - np.exp(-0.4 * D)) + 1, mo.CONSTANT, mo.EXPONENTIAL)["Exponential Saturation Fit"]
    assert r["affected"] == pytest.approx(np.mean(-math.log(0.05) / r["b"] > D))


def test_constant_wins_on_constant_data(spark):
    got = fit(spark, D, np.full(300, 3.0))
    assert [m for m, r in got.items() if r["is_best"]] == ["Constant Fit"]
    r = got["Constant Fit"]
    assert r["c"] == 3 and r["effect_strength"] == 0 and r["half_life"] == 0 and r["affected"] == 0 and r["entropy"] is None and r["relative_likelihood"] is None


def test_non_finite_rows_are_left_out(spark):
    s, d = np.ones(300), D.copy()
    s[::5], d[1::5], s[2::5] = np.nan, np.inf, -np.inf
    r = fit(spark, d, s, mo.CONSTANT)["Constant Fit"]
    assert r["included"] == pytest.approx(0.4) and r["n_included"] == 120 and r["c"] == 1
    with pytest.raises(ValueError, match="No valid data"):
        fit(spark, [1.0, 2.0], [np.nan, np.nan])


def test_constant_distance_fails_the_curves_only(spark):
    got = fit(spark, [5.0] * 30, [2.0] * 30)
    assert [m for m, r in got.items() if r["converged"]] == ["Constant Fit"]
    assert all(r["aic"] == math.inf and math.isnan(r["affected"]) and r["relative_likelihood"] == 0 for m, r in got.items() if m != "Constant Fit")


def test_threshold(spark):
    with pytest.raises(ValueError, match="threshold"):
        fit(spark, D, D, mo.CONSTANT, mo.MICHAELIS, threshold=1.0)


def test_statistics(spark):
    one = spark.range(1)
    ll = lambda n, v: one.select(se.log_likelihood(mo.F.lit(n), mo.F.lit(v))).first()[0]
    assert ll(100, 1.0) == pytest.approx(-50 * (math.log(2 * math.pi) + 1)) and ll(5, 0.0) > 0
    assert one.select(se.akaike(2, mo.F.lit(-10.0))).first()[0] == 24
    rl = lambda a, b, n: one.select(se.relative_likelihood(mo.F.lit(a), mo.F.lit(b), mo.F.lit(n))).first()[0]
    assert rl(42.0, 42.0, 100.0) == 1 and rl(40.0, 50.0, 100.0) > 1 > rl(60.0, 50.0, 100.0) and rl(40.0, 50.0, 10.0) > rl(40.0, 50.0, 1000.0) and rl(math.inf, 50.0, 10.0) == 0

    def entropy(weights):
        w = spark.createDataFrame([(float(x) / sum(weights),) for x in weights], "w double")
        return w.agg(se.weight_entropy(mo.F.col("w"), mo.F.count("*"))).first()[0]

    assert entropy([1]) == 0 and entropy([1] * 10) == pytest.approx(1) and entropy([1e6, 1, 1, 1, 1]) < 0.1
