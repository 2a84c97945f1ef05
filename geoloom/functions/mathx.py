"""Expressions that stay NULL where the arithmetic has no answer (sessions run in ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

EPS = 1e-10


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def rnd(x: Column, places: int = 6) -> Column:
    """Rounded for reports; -0.0 becomes 0.0."""
    return F.round(finite(x.cast("double")), places) + F.lit(0.0)


def ln_pos(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL (greatest and least skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def both(x: Column, y: Column) -> tuple[Column, Column]:
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over rows where both are there; NULL on constants.  Partially aggregated."""
    x, y = both(x, y)
    return div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def safe_corr_over(x: Column, y: Column, w: WindowSpec) -> Column:
    x, y = both(x, y)
    return div(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def zip_sum(a: Column, b: Column, f) -> Column:
    """Sum of f(a_i, b_i) over two arrays."""
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return zip_sum(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(zip_sum(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return div(dot(a, b), norm(a) * norm(b))


def quadratic(x: Column, matrix: list[list[float]]) -> Column:
    """x' M x with a small literal matrix."""
    total = F.lit(0.0)
    for i, row in enumerate(matrix):
        for j, m in enumerate(row):
            if m:
                total = total + F.get(x, F.lit(i)) * F.get(x, F.lit(j)) * F.lit(float(m))
    return total


#: Coefficients of a Chebyshev fit of the complementary error function (fractional error below 1.2e-7).  Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_sf(x: Column) -> Column:
    """Upper tail of the normal distribution."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + F.lit(c)
    tail = F.lit(0.5) * t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(1 - tail)


def chi2_sf_even(x: Column, dof: int) -> Column:
    """Upper tail of chi squared with an even number of degrees of freedom, in closed form."""
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * (x / 2) / k
        total = total + term
    return F.exp(-x / 2) * total
