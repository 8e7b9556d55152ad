"""Tail probabilities as column expressions: series and continued fractions over
``F.aggregate``, no Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series or continued fraction.
TERMS = 200


def _count(n: int) -> Column:
    return F.array(*[F.lit(float(i)) for i in range(1, n + 1)])


def _log_gamma(twice: Column) -> Column:
    """log of the gamma function at ``twice`` / 2, a whole number of halves above 0."""
    first = F.when(twice % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    start = F.when(twice % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi)))
    steps = (twice / 2 - first).cast("int")
    path = F.when(steps > 0, F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(path, start, lambda s, i: s + F.log(first + i))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom > x): the upper incomplete gamma function
    at (dof / 2, x / 2), by its series below the mean and by its continued fraction above.
    NULL for NULL or NaN and for dof below 1; 1 for x at or below 0."""
    a, h = dof / 2.0, x / 2.0
    front = F.exp(a * F.log(h) - h - _log_gamma(dof))
    one = F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s"))
    low = F.aggregate(_count(TERMS), one, lambda c, i: F.struct(
        (c["t"] * h / (a + i)).alias("t"), (c["s"] + c["t"] * h / (a + i)).alias("s")))
    # the modified Lentz recurrence, with (b, c, d) carried along
    start = F.struct((h + 1.0 - a).alias("b"), F.lit(1e300).alias("c"), (1.0 / (h + 1.0 - a)).alias("d"),
                     (1.0 / (h + 1.0 - a)).alias("f"))

    def lentz(s, i):
        up, b = i * (a - i), s["b"] + 2.0
        d, c = 1.0 / (up * s["d"] + b), b + up / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))
    high = F.aggregate(_count(TERMS), start, lentz)
    q = F.when(h < a + 1.0, 1.0 - front * low["s"]).otherwise(front * high["f"])
    return F.when(F.isnan(x) | x.isNull() | (dof < 1), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))


def ks_sf(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic: the
    alternating series for large arguments, its theta-function twin for small ones. NULL
    without rows on either side."""
    lam = d * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    far = F.aggregate(_count(20), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    odd = lambda k: (2.0 * k - 1.0) * (2.0 * k - 1.0)
    near = F.aggregate(_count(20), F.lit(0.0), lambda s, k: s + F.exp(odd(k) * (-math.pi ** 2 / 8) / (lam * lam)))
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1, 1.0 - math.sqrt(2 * math.pi) / lam * near).otherwise(far)
    return F.when((n1 > 0) & (n2 > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
