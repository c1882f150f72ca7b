"""Significance of a correlation as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction, and by how much an argument is raised before the series for large arguments is used.
STEPS, RAISED = 200, 32


def _log_gamma_ratio(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0: a series in 1/a at a + ``RAISED``, and the factors in between."""
    b = a + F.lit(float(RAISED))
    series = 0.5 * F.log(b) - 1 / (8 * b) + 1 / (192 * b * b * b) - 1 / (640 * F.pow(b, F.lit(5.0)))
    between = F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(0.0), lambda s, i: s + F.log((a + i) / (a + i + 0.5)))
    return series + between


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, stepped forward until its convergents settle."""
    tiny = F.lit(1e-300)
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def turn(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / away(1 + even * s["d"]), away(1 + even / s["c"])
        half = F.struct(d1.alias("d"), c1.alias("c"), (s["h"] * d1 * c1).alias("h"))
        return F.transform(F.array(half), lambda t: F.struct((1 / away(1 + odd * t["d"])).alias("d"), away(1 + odd / t["c"]).alias("c"), (t["h"] * (1 / away(1 + odd * t["d"])) * away(1 + odd / t["c"])).alias("h")))[0]

    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, turn)["h"]


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation ``r`` over ``n`` rows, by Student's t with n - 2 degrees of freedom.

    Null for a null or NaN ``r`` and for fewer than three rows; 0 for a perfect one.
    P = I(x; df / 2, 1 / 2) with x = 1 - r^2, the regularised incomplete beta function.
    """
    r, a, b = r.cast("double"), (n - 2).cast("double") / 2, F.lit(0.5)
    x = 1 - r * r
    front = F.exp(a * F.log(x) + F.log(F.abs(r)) + _log_gamma_ratio(a) - 0.5 * math.log(math.pi))
    near = x <= (a + 1) / (a + b + 2)
    value = F.when(near, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    exact = F.when(r == 0, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
    return F.when(r.isNotNull() & ~F.isnan(r) & (n >= 3), exact)
