"""Operators on series columns that Spark's built-in functions express, so they stay in the JVM.

Series are array<double>; a path is array<struct<i: int, j: int>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.settings import DistanceSettings


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda held, x: held + x)


def _last_held(values: Column, size: Column) -> Column:
    """values, repeated at its end up to the size."""
    return F.concat(values, F.array_repeat(F.element_at(values, -1), size - F.size(values)))


def euclidean(a: Column, b: Column, squared: bool = True) -> Column:
    """Point by point; what is left of the longer series meets the last point of the shorter."""
    n = F.greatest(F.size(a), F.size(b))
    if squared:
        return F.sqrt(_total(F.zip_with(_last_held(a, n), _last_held(b, n), lambda x, y: (x - y) * (x - y))))
    return _total(F.zip_with(_last_held(a, n), _last_held(b, n), lambda x, y: F.abs(x - y)))


def envelope_bound(a: Column, b: Column, window: int | None = None, squared: bool = True) -> Column:
    """LB_Keogh: how far a leaves the running minimum and maximum of b."""
    n, m = F.size(a), F.size(b)
    w = F.lit(window) if window else F.greatest(n, m)
    back, ahead = F.greatest(F.lit(0), n - m) + w - 1, F.greatest(F.lit(0), m - n) + w

    def off(x: Column, i: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), i - back), F.least(m, i + ahead)
        part = F.slice(b, lo + 1, F.greatest(F.lit(0), hi - lo))
        return F.when(hi <= lo, 0.0).otherwise(F.greatest(x - F.array_max(part), F.array_min(part) - x, F.lit(0.0)))

    outside = F.transform(a, off)
    return F.sqrt(_total(F.transform(outside, lambda x: x * x))) if squared else _total(outside)


def warping_distance(a: Column, b: Column, settings: DistanceSettings = DistanceSettings()) -> Column:
    """DTW as two nested folds: no Python. Window, penalty, max_step, max_dist and max_length_diff; no psi."""
    if settings.psi4 != (0, 0, 0, 0) or settings.window_type != "diagonal" or callable(settings.inner):
        raise ValueError("the fold takes neither psi nor a slanted window nor a custom point cost")
    inf, n, m = F.lit(float("inf")), F.size(a), F.size(b)
    penalty = F.lit(settings.to_cost(settings.penalty))
    w = settings.window or None

    def cell(x: Column, i: Column, row: Column, y: Column, j: Column, left: Column) -> Column:
        d = (x - y) * (x - y) if settings.squared else F.abs(x - y)
        best = F.least(F.get(row, j), F.get(row, j + 1) + penalty, left + penalty)
        out = d + best
        if settings.max_step is not None:
            out = F.when(d > settings.to_cost(settings.max_step), inf).otherwise(out)
        if w:
            inside = (j >= i - F.greatest(F.lit(0), n - m) - w + 1) & (j < i + F.greatest(F.lit(0), m - n) + w)
            out = F.when(inside, out).otherwise(inf)
        return out

    def next_row(row: Column, point: Column) -> Column:
        x, i = point["x"], point["i"]
        numbered = F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(numbered, F.array(inf), lambda made, p: F.concat(made, F.array(cell(x, i, row, p["y"], p["j"], F.element_at(made, -1)))))

    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, m))
    points = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    total = F.element_at(F.aggregate(points, first, next_row), -1)
    if settings.max_dist is not None:
        total = F.when(total > settings.to_cost(settings.max_dist), inf).otherwise(total)
    if settings.max_length_diff is not None:
        total = F.when(F.abs(n - m) > settings.max_length_diff, inf).otherwise(total)
    return F.sqrt(total) if settings.squared else total


def condensed_index(i: Column, j: Column, n: int | Column) -> Column:
    """Place of the pair i < j in the row-major upper triangle of n series."""
    n = F.lit(n) if isinstance(n, int) else n
    return (i * n - F.floor(i * (i + 1) / 2) + (j - i - 1)).cast("long")


# ---- one series


def differences(v: Column) -> Column:
    return F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda y, x: y - x)


def derivative(v: Column) -> Column:
    """Mean of the step before and half of the step over both neighbours; at the ends the step to the neighbour."""
    steps = differences(v)
    inner = F.transform(F.slice(v, 2, F.greatest(F.size(v) - 2, F.lit(0))), lambda x, i: ((x - F.get(v, i)) + (F.get(v, i + 2) - F.get(v, i)) / 2) / 2)
    return F.when(F.size(v) < 2, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.concat(F.slice(steps, 1, 1), inner, F.slice(steps, -1, 1)))


def mean(v: Column) -> Column:
    return _total(v) / F.size(v)


def _with_mean(v: Column, f) -> Column:
    """f(values, mean), the mean computed once: what a lambda refers to from outside is computed for each of its elements."""
    return F.get(F.transform(F.array(F.struct(v.alias("v"), mean(v).alias("m"))), lambda z: f(z["v"], z["m"])), F.lit(0))


def deviation(v: Column) -> Column:
    return _with_mean(v, lambda x, m: F.sqrt(_total(F.transform(x, lambda y: (y - m) * (y - m))) / F.size(x)))


def normalised(v: Column) -> Column:
    """Mean 0 and population deviation 1; a constant series becomes zeros."""
    held = F.array(F.struct(v.alias("v"), mean(v).alias("m"), deviation(v).alias("s")))
    return F.get(F.transform(held, lambda z: F.transform(z["v"], lambda x: F.when(z["s"] > 0, (x - z["m"]) / z["s"]).otherwise(0.0))), F.lit(0))


def log_domain(v: Column) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.log1p(F.abs(x)))


def mixed_log(v: Column, above: float, below: float | None = None) -> Column:
    """The identity from below to above, logarithmic beyond; below defaults to -above."""
    low = -above if below is None else below
    return F.transform(v, lambda x: F.when(x > above, above + F.log(x - above + 1)).when(x < low, low - F.log(low - x + 1)).otherwise(x))


def windows(v: Column, width: int, stride: int) -> Column:
    """array<struct<begin, values>> of all whole windows."""
    last = F.size(v) - width
    return F.when(last < 0, F.array().cast("array<struct<begin: int, values: array<double>>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda at: F.struct(at.alias("begin"), F.slice(v, at + 1, width).alias("values")))
    )


def sine_burst(length: int, start: Column | int, wave: Column | int) -> Column:
    """Zeros with one sine period of `wave` points from `start` on."""
    start, wave = (F.lit(x) if isinstance(x, int) else x for x in (start, wave))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.when((t >= start) & (t < start + wave), F.sin((t - start) * F.lit(6.283185307179586) / wave)).otherwise(0.0))


# ---- distances to similarities


def similarity(d: Column, method: str, r: Column | float, a: float = 1.0) -> Column:
    r = F.lit(r) if isinstance(r, (int, float)) else r
    if method == "exponential":
        return F.exp(-d / r)
    if method == "gaussian":
        return F.exp(-(d * d) / (r * r))
    if method == "reciprocal":
        return 1 / (r + a * d)
    if method == "reverse":
        return (r - d) / r
    raise ValueError(method)


def default_range(method: str, least: Column, most: Column) -> Column:
    """r when none is given, from the least and largest distance."""
    return {"exponential": most, "gaussian": most, "reciprocal": F.lit(1.0), "reverse": least + most}[method]


def range_covering(method: str, quantile: float | Column, share: float, a: float = 1.0):
    """r so that the similarity at the given distance quantile is 1 - share."""
    import math

    target = 1 - share
    if method == "exponential":
        return quantile / -math.log(target)
    if method == "gaussian":
        return quantile / math.sqrt(-math.log(target))
    if method == "reciprocal":
        return 1 / target - a * quantile
    if method == "reverse":
        return quantile / share
    raise ValueError(method)


def squash(x: Column, method: str = "logistic", r: Column | float = 1.0, x0: Column | float = 0.0, base: float = 2.718281828459045, keep_sign: bool = False) -> Column:
    """Values to [0, 1): logistic around x0, or rising from 0 as gaussian or exponential."""
    r, x0 = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (r, x0))
    b = F.lit(base)

    def curve(v: Column) -> Column:
        if method == "logistic":
            return 1 / (1 + F.pow(b, -(v - x0) / r))
        if method == "gaussian":
            return 1 - F.pow(b, -(v * v) / (r * r))
        if method == "exponential":
            return 1 - F.pow(b, -v / r)
        raise ValueError(method)

    return F.signum(x) * (curve(F.abs(x)) - curve(F.lit(0.0))) if keep_sign else curve(x)


# ---- paths


def warping_amount(path: Column) -> Column:
    """Steps that aren't diagonal."""
    steps = F.zip_with(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), lambda q, p: (q["i"] - p["i"]) + (q["j"] - p["j"]))
    return F.size(F.filter(steps, lambda s: s != 2))


def path_distance(path: Column, a: Column, b: Column, relaxed: bool = False, squared: bool = True) -> Column:
    """Distance along a given path; relaxed: every point may move by half of its derivative to either side."""

    def cost(z: Column, p: Column) -> Column:
        x, y = F.get(z["a"], p["i"]), F.get(z["b"], p["j"])
        if not relaxed:
            d = F.abs(x - y)
        else:
            u, v = F.get(z["da"], p["i"]) / 2, F.get(z["db"], p["j"]) / 2
            d = F.least(*[F.abs((x + s * u) - (y + t * v)) for s in (1, -1) for t in (1, -1)])
        return d * d if squared else d

    # a lambda's outer expressions are computed for each element: the series and derivatives are bound once
    parts = [path.alias("p"), a.alias("a"), b.alias("b")] + ([derivative(a).alias("da"), derivative(b).alias("db")] if relaxed else [])
    total = F.get(F.transform(F.array(F.struct(*parts)), lambda z: _total(F.transform(z["p"], lambda p: cost(z, p)))), F.lit(0))
    return F.sqrt(total) if squared else total


def far_points(path: Column, a: Column, b: Column, least: float) -> Column:
    """Steps of the path at which the series are apart by at least so much."""
    return F.filter(path, lambda p: F.abs(F.get(a, p["i"]) - F.get(b, p["j"])) >= least)


def path_slice(path: Column, row_begin: int = 0, row_end: int | None = None, col_begin: int = 0, col_end: int | None = None) -> Column:
    """Steps within the rectangle, counted from its corner."""
    inside = F.filter(path, lambda p: (p["i"] >= row_begin) & (p["j"] >= col_begin) & (F.lit(True) if row_end is None else p["i"] < row_end) & (F.lit(True) if col_end is None else p["j"] < col_end))
    return F.transform(inside, lambda p: F.struct((p["i"] - row_begin).alias("i"), (p["j"] - col_begin).alias("j")))


def misalignment(path: Column) -> Column:
    """j - i of every step."""
    return F.transform(path, lambda p: p["j"] - p["i"])
