"""Distribution functions on plain numpy and math: normal, chi-square, F, Student t, Kolmogorov."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    for n in range(1, 1000):
        term *= x / (a + n)
        total += term
        if abs(term) < abs(total) * 1e-15:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _lentz(pairs, b0: float) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...))."""
    tiny = 1e-300
    f = b0 or tiny
    c, d = f, 0.0
    for a, b in pairs:
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        return _gamma_series(a, x)
    frac = _lentz(((-n * (n - a), x + 2 * n + 1 - a) for n in range(1, 1000)), x + 1 - a)
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) / frac


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def steps():
        yield 1.0, 1.0
        for m in range(0, 1000):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _lentz(steps(), 0.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    if not x > 0:
        return 1.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def kolmogorov_sf(x: float) -> float:
    if x <= 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Distance and asymptotic p."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max())
    n = math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    return d, kolmogorov_sf((n + 0.12 + 0.11 / n) * d)
