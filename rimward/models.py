"""Curves of a score S over the distance d, fitted per sample and measure by aggregates.

Input is long: (sample_id, measure, node_id, d, S). For a fixed inner parameter b each curve is linear in its other two
parameters, S = m * x(d, b) + c, so its least squares are sums. The plateau's b is found exactly from running sums over the distinct
distances; the other two by zooming in on a grid of log b. A fit row is

    sample_id, measure, model, model_ord, converged, b, m, c, ll, aic, n_all, n_included, included, affected,
    effect_strength, half_life, plateau

with the amplitude (a) of saturating curves in ``m`` and the level that a curve approaches in ``plateau``. Curves of one's own with
any parameters (:class:`rimward.free_curves.FreeCurve`) have them in the array ``p``, and b, m and c are NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimward.criteria import TINY, akaike, log_likelihood
from rimward.expr import clip, is_finite
from rimward.free_curves import FreeCurve, fit_free
from rimward.storage import stored

EPS = 1e-10
B_MIN, STEPS, ZOOMS = 1e-6, 64, 3
#: Ranges of the distances of a group are COARSE * COARSE.
COARSE = 32
KEYS = ["sample_id", "measure"]
NAN = float("nan")


@dataclass(frozen=True)
class CurveModel:
    """A curve S = m * basis(d, b) + c.

    ``limit`` is the basis far from the border, ``half`` the d at which a share y of m is reached, ``reached`` the
    distance of the given share of saturation, ``b_max`` the largest b tried and ``allowed`` a condition of the fit, both over
    the statistics of a group. ``params`` are the names of b, m and c in reports.
    """

    name: str
    key: str
    params: tuple[str, str, str]
    basis: Callable[[Column, Column], Column]
    limit: Callable[[Column], Column]
    half: Callable[[Column, Column, Column, Column], Column] | None = None
    reached: Callable[[Column, float], Column] | None = None
    b_max: Callable[[], Column] | None = None
    allowed: Callable[[], Column] | None = None
    n_params: int = 3


def piecewise_curve(d: Column, b: Column, m: Column, c: Column) -> Column:
    return m * F.least(d, b) + c


def exponential_curve(d: Column, a: Column, b: Column, c: Column) -> Column:
    return a * (1.0 - F.exp(-b * d)) + c


def michaelis_curve(d: Column, a: Column, b: Column, c: Column) -> Column:
    return a * d / (b + d) + c


CONSTANT = CurveModel("Constant Fit", "constant", ("b", "m", "constant_c"), lambda d, b: F.lit(0.0), lambda b: F.lit(0.0), n_params=1)
PIECEWISE = CurveModel(
    "Piecewise Linear Fit", "piecewise_linear", ("piecewise_linear_b", "piecewise_linear_m", "piecewise_linear_c"), lambda d, b: F.least(d, b), lambda b: b
)
EXPONENTIAL = CurveModel(
    "Exponential Saturation Fit", "exponential_saturation", ("exponential_saturation_b", "exponential_saturation_a", "exponential_saturation_c"),
    lambda d, b: 1.0 - F.exp(-b * d), lambda b: F.lit(1.0),
    half=lambda y, m, b, c: F.coalesce(-F.log(1.0 - (y - c) / (m + EPS)) / b, F.lit(NAN)),
    reached=lambda b, share: F.lit(-math.log(1.0 - share)) / b,
    b_max=lambda: 50.0 / F.col("d_least"),
    allowed=lambda: 1.0 / (F.col("d_mean") + 1e-6) >= B_MIN,
)
MICHAELIS = CurveModel(
    "Michaelis-Menten Fit", "michaelis_menten", ("michaelis_menten_b", "michaelis_menten_a", "michaelis_menten_c"),
    lambda d, b: d / (b + d), lambda b: F.lit(1.0),
    half=lambda y, m, b, c: F.try_divide(b * (y - c), m - y + c + EPS),
    reached=lambda b, share: b * (share / (1.0 - share)),
    b_max=lambda: 1e3 * F.col("d_max"),
    # whether the median of d reaches B_MIN, from counts and the two values around B_MIN
    allowed=lambda: (2 * F.col("n_high") > F.col("n")) | ((2 * F.col("n_high") == F.col("n")) & ((F.col("d_below") + F.col("d_above")) / 2 >= B_MIN)),
)
DEFAULT_MODELS = (CONSTANT, PIECEWISE, EXPONENTIAL, MICHAELIS)


def with_included(rows: DataFrame) -> DataFrame:
    return rows.withColumn("included", is_finite(F.col("S")) & is_finite(F.col("d")))


def group_statistics(rows: DataFrame) -> DataFrame:
    """Per group: rows, included rows and the statistics of those."""
    marked = with_included(rows)
    d, s = F.when(F.col("included"), F.col("d")), F.when(F.col("included"), F.col("S"))
    return marked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_all"), F.count(d).alias("n"), F.min(d).alias("d_min"), F.max(d).alias("d_max"), F.avg(d).alias("d_mean"),
        F.count(F.when(d >= B_MIN, d)).alias("n_high"), F.max(F.when(d < B_MIN, d)).alias("d_below"), F.min(F.when(d >= B_MIN, d)).alias("d_above"),
        F.min(F.when(d > 0, d)).alias("d_least"), F.avg(s).alias("s_mean"),
    )


def by_distance(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Included rows summed per distinct distance, with S centred at the group's mean: (keys, d, n_d, s1, s2)."""
    joined = with_included(rows).where("included").join(statistics.select(*KEYS, "s_mean"), KEYS).withColumn("s", F.col("S") - F.col("s_mean"))
    return joined.groupBy(*KEYS, "d").agg(F.count(F.lit(1)).alias("n_d"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))


def _least_squares(n: Column, x: Column, xx: Column, xs: Column, s: Column, ss: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and squared error of S on x from sums; a constant x has slope 0."""
    sxx, sxy, syy = xx - x * x / n, xs - x * s / n, ss - s * s / n
    slope = F.when(sxx > 1e-12 * F.greatest(xx, F.lit(TINY)), sxy / F.nullif(sxx, F.lit(0.0))).otherwise(F.lit(0.0))
    return slope, (s - slope * x) / n, F.greatest(syy - slope * sxy, F.lit(0.0))


def _fit_constant(points: DataFrame, statistics: DataFrame) -> DataFrame:
    return statistics.where("n > 0").select(*KEYS, F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("m"), F.col("s_mean").alias("c"), F.lit(True).alias("converged"))


def in_ranges(points: DataFrame) -> DataFrame:
    """``points`` with their ``bucket``, ranges of d with about equally many distinct distances each, wherever those lie.

    The cuts are approximate quantiles, off by a ten-thousandth of the group at most; which range a distance is in changes no sum over all.
    """
    most = COARSE * COARSE
    cuts = points.groupBy(*KEYS).agg(F.percentile_approx("d", [i / most for i in range(1, most)], 10_000).alias("cuts"))
    below = lambda some: F.size(F.filter(some, lambda x: x < F.col("d")))
    # how many cuts are below d: of every COARSE-th first, then of those between two of them
    coarse = cuts.withColumn("coarse", F.transform(F.sequence(F.lit(COARSE), F.lit(most - 1), F.lit(COARSE)), lambda i: F.get(F.col("cuts"), i - 1)))
    placed = points.join(coarse, KEYS).withColumn("bucket", below(F.col("coarse")))
    return placed.withColumn("bucket", F.col("bucket") * COARSE + below(F.slice("cuts", F.col("bucket") * COARSE + 1, COARSE))).drop("cuts", "coarse")


def _fit_plateau(points: DataFrame, statistics: DataFrame) -> DataFrame:
    """The exact minimum over b: at each distinct distance, and between neighbours where the left line meets the right mean.

    Running sums are taken within ranges of d and then over ranges, so no window holds a whole group.
    """
    rows = in_ranges(points).join(statistics.select(*KEYS, "n", "d_min", "d_max", "s_mean"), KEYS)
    u = F.col("d") - F.col("d_min")
    rows = rows.withColumns({"u": u, "k": F.col("n_d"), "ku": F.col("n_d") * u, "kuu": F.col("n_d") * u * u, "us": u * F.col("s1")})
    sums = ["k", "ku", "kuu", "us", "s1", "s2"]
    per = rows.groupBy(*KEYS, "bucket").agg(*[F.sum(c).alias(f"{c}_bucket") for c in sums], F.min("d").alias("first_d"))
    earlier = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy(*KEYS).orderBy("bucket")
    every = Window.partitionBy(*KEYS)
    per = per.select(
        *KEYS, "bucket", *[F.coalesce(F.sum(f"{c}_bucket").over(earlier), F.lit(0.0)).alias(f"{c}_before") for c in sums],
        *[F.sum(f"{c}_bucket").over(every).alias(f"{c}_all") for c in sums], F.lead("first_d").over(following).alias("next_first"),
    )
    inside = Window.partitionBy(*KEYS, "bucket").orderBy("d")
    rows = rows.join(per, [*KEYS, "bucket"])
    left = {c: F.col(f"{c}_before") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in sums}
    rows = rows.withColumns({f"{c}_left": v for c, v in left.items()} | {"next_d": F.coalesce(F.lead("d").over(inside), F.col("next_first"))})
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in sums}
    n, at = F.col("k_all").cast("double"), F.col("u")
    # b at this distance: the basis is u up to here and constant beyond
    m1, c1, e1 = _least_squares(
        n, F.col("ku_left") + at * right["k"], F.col("kuu_left") + at * at * right["k"], F.col("us_left") + at * right["s1"], F.col("s1_all"), F.col("s2_all")
    )
    # b between this distance and the next: a free line on the left, the mean on the right
    m2, c2, e2 = _least_squares(F.col("k_left").cast("double"), F.col("ku_left"), F.col("kuu_left"), F.col("us_left"), F.col("s1_left"), F.col("s2_left"))
    mean = F.try_divide(right["s1"], F.nullif(right["k"], F.lit(0)))
    e2 = e2 + F.greatest(right["s2"] - right["s1"] * mean, F.lit(0.0))
    meet = F.try_divide(mean - c2, F.nullif(m2, F.lit(0.0)))
    between = meet.isNotNull() & (meet > at) & (meet < F.col("next_d") - F.col("d_min"))
    both = rows.select(*KEYS, "d_min", "d_max", "s_mean", F.explode(F.array(
        F.struct(e1.alias("e"), F.col("d").alias("b"), m1.alias("m"), c1.alias("c")), F.when(between, F.struct(e2.alias("e"), (meet + F.col("d_min")).alias("b"), m2.alias("m"), c2.alias("c")))
    )).alias("f")).where("f IS NOT NULL")
    best = both.groupBy(*KEYS, "d_min", "d_max", "s_mean").agg(F.min("f").alias("f"))
    c = F.col("f.c") - F.col("f.m") * F.col("d_min") + F.col("s_mean")
    return best.select(*KEYS, F.col("f.b").alias("b"), F.col("f.m").alias("m"), c.alias("c"), (F.col("d_max") > F.col("d_min")).alias("converged"))


def _by_model(models: Sequence[CurveModel], value: Callable[[CurveModel], Column]) -> Column:
    """``value`` of the model named in the column ``model``."""
    out = F.when(F.col("model") == models[0].name, value(models[0]))
    for model in models[1:]:
        out = out.when(F.col("model") == model.name, value(model))
    return out


def _fit_saturating(models: Sequence[CurveModel], points: DataFrame, statistics: DataFrame) -> DataFrame:
    """All the models at once. Zoom in on log b: the squared error at evenly spaced values, then between the neighbours of the best; last a parabola through three."""
    keys = [*KEYS, "model"]
    low = F.lit(math.log(B_MIN))

    def begin(model: CurveModel) -> DataFrame:
        high = F.log(F.greatest(model.b_max(), F.lit(10 * B_MIN)))
        able = F.coalesce((F.col("d_max") > F.col("d_min")) & F.col("d_least").isNotNull() & model.allowed(), F.lit(False))
        return statistics.where("n > 0").select(*KEYS, F.lit(model.name).alias("model"), "s_mean", able.alias("able"), low.alias("low"), ((high - low) / STEPS).alias("step"))

    search = stored(reduce(DataFrame.unionByName, map(begin, models)), "search")

    def errors(search: DataFrame, steps: int) -> DataFrame:
        rows = points.join(search.where("able"), KEYS)
        rows = rows.select(*keys, "low", "step", "n_d", "d", "s1", "s2", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
        rows = rows.withColumn("b", F.exp(F.col("low") + F.col("i") * F.col("step"))).withColumn("x", _by_model(models, lambda m: m.basis(F.col("d"), F.col("b"))))
        w = F.col("n_d") * F.col("x")
        sums = rows.groupBy(*keys, "low", "step", "i").agg(
            F.sum("n_d").cast("double").alias("k"), F.sum(w).alias("sx"), F.sum(w * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("s1")).alias("sxs"), F.sum("s1").alias("ss1"), F.sum("s2").alias("ss2")
        )
        m, c, e = _least_squares(*[F.col(a) for a in ("k", "sx", "sxx", "sxs", "ss1", "ss2")])
        return sums.select(*keys, "low", "step", "i", m.alias("m"), c.alias("c"), e.alias("e"))

    for _ in range(ZOOMS):
        best = errors(search, STEPS).groupBy(*keys, "low", "step").agg(F.min(F.struct("e", "i"))["i"].alias("i"))
        near = F.col("low") + clip(F.col("i") - 1, F.lit(0), F.lit(STEPS - 2)) * F.col("step")
        zoomed = best.select(*keys, near.alias("low2"), (F.col("step") * 2 / STEPS).alias("step2"))
        search = stored(search.join(zoomed, keys, "left").select(*keys, "s_mean", "able", F.coalesce("low2", "low").alias("low"), F.coalesce("step2", "step").alias("step")), "search", replaces=search)
    three = errors(search, STEPS).groupBy(*keys, "low", "step").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("es"), F.min(F.struct("e", "i"))["i"].alias("i"))
    e = lambda k: F.get(F.col("es"), F.col("i") + k)["e"]
    bend = e(-1) - 2 * e(0) + e(1)
    shift = F.coalesce(F.when(bend > 0, (e(-1) - e(1)) / (2 * F.nullif(bend, F.lit(0.0)))), F.lit(0.0))
    final = three.select(*keys, (F.col("low") + (F.col("i") + clip(shift, F.lit(-1.0), F.lit(1.0))) * F.col("step")).alias("low"))
    found = search.drop("low").join(final, keys).withColumn("step", F.lit(0.0))
    at = errors(found, 0).select(*keys, F.exp("low").alias("b"), "m", "c")
    out = search.select(*keys, "s_mean", "able").join(at, keys, "left")
    return out.select(*keys, "b", "m", (F.col("c") + F.col("s_mean")).alias("c"), (F.col("able") & F.col("b").isNotNull()).alias("converged"))


def _fitted(models: Sequence[CurveModel], points: DataFrame, statistics: DataFrame) -> DataFrame:
    """(keys, model, b, m, c, converged) of every model."""
    one = {CONSTANT.key: _fit_constant, PIECEWISE.key: _fit_plateau}
    parts = [one[m.key](points, statistics).withColumn("model", F.lit(m.name)) for m in models if m.key in one]
    if saturating := [m for m in models if m.key not in one and not isinstance(m, FreeCurve)]:
        parts.append(_fit_saturating(saturating, points, statistics))
    parts = [part.withColumn("p", F.lit(None).cast("array<double>")) for part in parts]
    nan = F.lit(NAN)
    free = [(m, fit_free(m, points, statistics)) for m in models if isinstance(m, FreeCurve)]
    parts += [fit.select(*KEYS, nan.alias("b"), nan.alias("m"), nan.alias("c"), "converged", F.lit(m.name).alias("model"), "p") for m, fit in free]
    return reduce(DataFrame.unionByName, parts)


def predicted(model: CurveModel, d: Column | None = None) -> Column:
    """The model's S from columns b, m and c of a fit row."""
    if model.key == CONSTANT.key:
        return F.col("c")
    if isinstance(model, FreeCurve):
        return model.at(F.col("d") if d is None else d, F.col("p"))
    return F.col("m") * model.basis(F.col("d") if d is None else d, F.col("b")) + F.col("c")


def _affected(model: CurveModel, threshold: float) -> Column:
    """1 where the border reaches a node."""
    if model.key == CONSTANT.key:
        return F.lit(0.0)
    if isinstance(model, FreeCurve):
        return F.lit(NAN) if model.reached is None else (F.col("d") < model.reached(model.named(F.col("p")), threshold)).cast("double")
    within = F.col("d") <= F.col("b") if model.reached is None else F.col("d") < model.reached(F.col("b"), threshold)
    return within.cast("double")


def _report(model: CurveModel, order: int, fitted: DataFrame) -> DataFrame:
    """The fit rows of one model."""
    ll = log_likelihood(F.col("n"), F.col("mse"))
    if model.key == CONSTANT.key:
        strength, half = F.lit(0.0), F.lit(0.0)
        plateau = F.col("c")
    else:
        border, centre = predicted(model, F.col("d_min")), predicted(model, F.col("d_max"))
        strength = F.try_divide(border - centre, border + centre + EPS)
        middle = (border + centre) / 2
        if isinstance(model, FreeCurve):
            named = model.named(F.col("p"))
            raw = F.lit(NAN) if model.half is None else model.half(middle, named)
            plateau = centre if model.limit is None else model.limit(named)
        else:
            raw = F.try_divide(middle - F.col("c"), F.col("m") + EPS) if model.half is None else model.half(middle, F.col("m"), F.col("b"), F.col("c"))
            plateau = F.col("m") * model.limit(F.col("b")) + F.col("c")
        half = raw / (F.col("d_max") + EPS)
    ok = F.col("converged")
    nan_unless = lambda v: F.when(ok, F.coalesce(v, F.lit(NAN))).otherwise(F.lit(NAN))
    kept = (lambda v: v) if model.key == CONSTANT.key else nan_unless
    return fitted.where(F.col("model") == model.name).select(
        *KEYS, "model", F.lit(order).alias("model_ord"), ok.alias("converged"), kept(F.col("b")).alias("b"), kept(F.col("m")).alias("m"), nan_unless(F.col("c")).alias("c"), F.when(ok, F.col("p")).alias("p"),
        F.when(ok, ll).otherwise(F.lit(float("-inf"))).alias("ll"), F.when(ok, akaike(model.n_params + 1, ll)).otherwise(F.lit(float("inf"))).alias("aic"),
        "n_all", F.col("n").alias("n_included"), (F.col("n") / F.col("n_all")).alias("included"), nan_unless(F.col("affected")).alias("affected"),
        nan_unless(strength).alias("effect_strength"), nan_unless(half).alias("half_life"), nan_unless(plateau).alias("plateau"),
    )


def fit_models(rows: DataFrame, models: tuple[CurveModel | FreeCurve, ...] = DEFAULT_MODELS, baseline: CurveModel = CONSTANT, threshold: float = 0.95) -> DataFrame:
    """Fit rows of all models; the baseline comes last in ``model_ord``. Groups without included rows are an error.

    Residuals are taken anew from the rows, so that small errors keep their digits: one pass for all models.
    """
    if any(m.reached is not None for m in models) and not 0 < threshold < 1:
        raise ValueError("The threshold must lie between 0 and 1.")
    rows = stored(rows.select(*KEYS, "node_id", F.col("d").cast("double"), F.col("S").cast("double")), "observations")
    statistics = stored(group_statistics(rows), "statistics")
    if statistics.where("n = 0").limit(1).count():
        raise ValueError("No valid data: a sample has no finite pair of distance and score.")
    points = stored(by_distance(rows, statistics), "by-distance")
    ordered = [m for m in models if m.key != baseline.key] + [baseline]
    params = stored(_fitted(ordered, points, statistics), "fit")
    near = with_included(rows).where("included").join(params.where("converged"), KEYS)
    residual = F.col("S") - _by_model(ordered, predicted)
    error = near.groupBy(*KEYS, "model").agg(F.avg(residual * residual).alias("mse"), F.avg(_by_model(ordered, lambda m: _affected(m, threshold))).alias("affected"))
    fitted = stored(statistics.where("n > 0").join(params, KEYS).join(error, [*KEYS, "model"], "left"), "fitted")
    return reduce(DataFrame.unionByName, [_report(m, i, fitted) for i, m in enumerate(ordered)])
