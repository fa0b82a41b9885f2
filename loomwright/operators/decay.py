"""Exponential decay fitted to a few points, as column expressions only.

The least-squares fit of ``height * exp(-rate * t)`` is found by damped Gauss-Newton steps;
for a given rate the best height follows in closed form. A fit that isn't found is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import rounded

#: Thresholds in percent, limits of the labels, and the least number of points.
THETA = (50, 80, 90, 95, 99)
EXCELLENT, GOOD = 0.9, 0.7
LEAST_POINTS = 3
#: The rate that a search begins with, and the evaluations after which it has failed.
FIRST_RATE, EVALUATIONS = 0.5, 10_000
#: A rate below this is no decay: there is no time to reach a threshold.
FLAT = 1e-12


def _sum(points: Column, of) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + of(p))


def height(points: Column, rate: Column) -> Column:
    """The best height for a rate."""
    return _sum(points, lambda p: p["y"] * F.exp(-rate * p["i"])) / _sum(points, lambda p: F.exp(-rate * p["i"] * 2))


def solved(points: str, evaluations: int = EVALUATIONS) -> Column:
    """``e, l`` with the least squares of ``e * exp(-l * i)`` for a column of points (i, y) with positive y; null if it isn't found.

    Damped Gauss-Newton steps from the first value and a rate of ``FIRST_RATE``, both kept at 0 or
    above; a rate of 0 that would have to fall further stays while the height is solved alone. A step
    that doesn't lower the squares is damped more, another one less. It ends where no step lowers them
    any more; so many evaluations of the squares without an end are a failure.
    """

    def bind(value: str, name: str, body: str) -> str:
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    def squares(e: str, rate: str) -> str:
        return f"aggregate(`{points}`, 0D, (t, x) -> t + pow(x.y - {e} * exp(-{rate} * x.i), 2D))"

    # Sums of the normal equations: products of the two derivatives f and -e i f, and of these with what is missed.
    added = bind("named_struct('f', exp(-s.l * x.i), 'd', -s.e * x.i * exp(-s.l * x.i), 'r', x.y - s.e * exp(-s.l * x.i))", "z", "named_struct('a', t.a + z.f * z.f, 'b', t.b + z.f * z.d, 'c', t.c + z.d * z.d, 'g', t.g + z.f * z.r, 'h', t.h + z.d * z.r)")
    sums = f"aggregate(`{points}`, named_struct('a', 0D, 'b', 0D, 'c', 0D, 'g', 0D, 'h', 0D), (t, x) -> {added})"
    damped = "named_struct('a', m.a * (1 + s.mu), 'b', m.b, 'c', m.c * (1 + s.mu), 'g', m.g, 'h', m.h)"
    alone = "(s.l <= 0 AND n.h <= 0) OR n.a * n.c - n.b * n.b <= 0"
    step = f"IF({alone}, named_struct('e', greatest(s.e + n.g / n.a, 0D), 'l', s.l), named_struct('e', greatest(s.e + (n.c * n.g - n.b * n.h) / (n.a * n.c - n.b * n.b), 0D), 'l', greatest(s.l + (n.a * n.h - n.b * n.g) / (n.a * n.c - n.b * n.b), 0D)))"
    near = "abs(q.e - s.e) <= 1e-14 * q.e AND abs(q.l - s.l) <= 1e-14 * q.l"
    judged = f"IF(c <= s.c, named_struct('e', q.e, 'l', q.l, 'mu', greatest(s.mu / 5, 1e-15D), 'c', c, 'done', {near}), named_struct('e', s.e, 'l', s.l, 'mu', s.mu * 4, 'c', s.c, 'done', s.mu > 1e15D))"
    moved = bind(sums, "m", bind(damped, "n", bind(step, "q", bind(squares("q.e", "q.l"), "c", judged))))
    first = f"get(`{points}`, 0).y"
    start = f"named_struct('e', {first}, 'l', {FIRST_RATE}D, 'mu', 1e-3D, 'c', {squares(first, f'{FIRST_RATE}D')}, 'done', false)"
    return F.expr(f"aggregate(sequence(1, {evaluations}), {start}, (s, k) -> IF(s.done, s, {moved}), s -> IF(s.done, named_struct('e', s.e, 'l', s.l), NULL))")


def with_fit(frame, points: str = "points"):
    """Adds ``lambda, fitted_E_0, r_squared, fit_quality`` for a column of points (i, y).

    Only positive values count. With fewer than three of them there is no rate and no R²,
    and the height is the first value as it is; if the solver fails, rate, height and R² are null.
    """
    p = F.col("fit_points")
    enough = F.size(p) >= LEAST_POINTS
    frame = frame.withColumn("fit_points", F.filter(points, lambda x: x["y"] > 0))
    frame = frame.withColumn("lambda", F.when(enough, solved("fit_points")["l"]))
    first = F.get(F.col(points), F.lit(0))["y"]
    frame = frame.withColumn("fitted_E_0", F.when(enough, height(p, F.col("lambda"))).otherwise(first))
    mean = _sum(p, lambda x: x["y"]) / F.size(p)
    missed = _sum(p, lambda x: F.pow(x["y"] - F.col("fitted_E_0") * F.exp(-F.col("lambda") * x["i"]), F.lit(2)))
    total = _sum(p, lambda x: F.pow(x["y"] - mean, F.lit(2)))
    frame = frame.withColumn("r_squared", F.when(enough, F.when(total > 0, 1 - missed / total).otherwise(F.lit(0.0))))
    return frame.withColumn("fit_quality", quality(F.col("r_squared"))).drop("fit_points")


def quality(r_squared: Column) -> Column:
    return F.when(r_squared.isNull(), "N/A").when(r_squared > EXCELLENT, "excellent").when(r_squared > GOOD, "good").otherwise("poor")


def threshold_time(rate: Column, theta: Column) -> Column:
    """When so many percent of the effect are used up; null without decay or outside 0 to 100."""
    return F.when((rate >= FLAT) & (theta > 0) & (theta < 100), F.log(F.lit(100.0) / (F.lit(100.0) - theta)) / rate)


def thresholds(rate: Column, theta: tuple[int, ...] = THETA) -> Column:
    """For each threshold its time and the attempts that it takes; empty without a rate."""
    every = F.transform(F.array(*map(F.lit, theta)), lambda t: F.struct(t.alias("theta"), threshold_time(rate, t).alias("t_theta"), F.ceil(threshold_time(rate, t)).alias("t_theta_ceiling")))
    return F.when(rate.isNotNull(), every).otherwise(F.array().cast("array<struct<theta:int,t_theta:double,t_theta_ceiling:bigint>>"))


def curve(height_: Column, rate: Column, until: Column, samples: int = 100) -> Column:
    """Evenly spaced points of the fitted curve from 0 to ``until``."""
    x = lambda k: k * until / (samples - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.struct(k.alias("k"), x(k).alias("t"), (height_ * F.exp(-rate * x(k))).alias("e")))


def rounded_record(norm: str = "norm", a_phi: str = "A_phi") -> list[Column]:
    """The result's scalars, rounded to what a comparison can hold them to."""
    return [rounded(F.col("lambda"), 4).alias("lambda"), rounded(F.col("fitted_E_0"), 4).alias("fitted_E_0"), rounded(F.col("r_squared"), 4).alias("r_squared"), F.col("fit_quality")]
