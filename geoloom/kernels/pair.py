"""Kernels on two aligned series."""

from __future__ import annotations

import math

import numpy as np

from geoloom.functions.special import f_sf
from geoloom.kernels.series import EPS, adf, adf_aic, cwt, ols


def _lags(v: np.ndarray, k: int) -> list[np.ndarray]:
    return [v[k - i : len(v) - i] for i in range(1, k + 1)]


def granger(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[float, float]:
    """F and p of "x leads y": the lags of x beyond y's own."""
    z = y[lags:]
    own = np.column_stack([np.ones(len(z)), *_lags(y, lags)])
    full = np.column_stack([own, *_lags(x, lags)])
    _, _, r0 = ols(own, z)
    _, _, r1 = ols(full, z)
    df = len(z) - full.shape[1]
    if df <= 0 or r1 <= 0:
        return math.nan, math.nan
    f = (r0 - r1) / lags / (r1 / df)
    return float(f), float(f_sf(f, lags, df))


def granger_both(x: np.ndarray, y: np.ndarray, most: int = 5, difference: bool = True) -> dict:
    """Both ways, the lag with the largest F of 1..most."""
    if difference:
        x, y = np.diff(x), np.diff(y)
    out = {}
    for name, a, b in (("1_to_2", x, y), ("2_to_1", y, x)):
        f, p, k = max(((*granger(a, b, k), k) for k in range(1, most + 1)), key=lambda r: (r[0] if math.isfinite(r[0]) else -1))
        out |= {f"granger_f_{name}": f, f"granger_p_{name}": p, f"granger_lag_{name}": k}
    return out


def dtw(x: np.ndarray, y: np.ndarray, band: int | None = None, most: int | None = None) -> dict:
    """Dynamic time warping of z-scores, squared cost, by anti-diagonals.

    Series are read whole; ``band`` limits the warp to so many places off the
    diagonal, ``most`` thins longer series to so many points.
    """
    if most:
        x, y = (v[np.linspace(0, len(v) - 1, min(len(v), most)).round().astype(int)] for v in (x, y))
    x, y = (x - x.mean()) / (x.std() + EPS), (y - y.mean()) / (y.std() + EPS)
    n, m = len(x), len(y)
    cost = (x[:, None] - y[None, :]) ** 2
    if band is not None:
        cost[np.abs(np.arange(n)[:, None] * m / n - np.arange(m)[None, :]) > band] = np.inf
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        d[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        k = int(np.argmin([d[i - 1, j - 1], d[i - 1, j], d[i, j - 1]]))
        i, j = (i - 1, j - 1) if k == 0 else (i - 1, j) if k == 1 else (i, j - 1)
    p = np.array(path)
    distance = math.sqrt(d[n, m])
    k = min(n, m)
    straight = math.sqrt(((x[:k] - y[:k]) ** 2).sum())
    return {"dtw_distance": distance, "dtw_normalized": distance / len(p), "dtw_warping": float(len(p) / max(n, m) - 1), "dtw_mean_offset": float((p[:, 0] - p[:, 1]).mean()), "dtw_euclid_ratio": distance / (straight + EPS)}


#: Critical values of the residual-based test with two series (1, 5, 10 %) and p-values by bucket.  Fixed values.
CRITICAL = ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10))


def cointegration(x: np.ndarray, y: np.ndarray, significance: float = 0.1) -> dict:
    """Engle-Granger: ADF of the residual of y on x; half-life, spread, hedge stability over halves."""
    beta, e, _ = ols(np.column_stack([np.ones(len(x)), x]), y)
    t, _ = adf_aic(e)
    p = next((q for c, q in CRITICAL if t < c), 0.5)
    d, lag = np.diff(e), e[:-1]
    lam = float(lag @ d / (lag @ lag + 1e-300))
    h = len(x) // 2
    slope = lambda a, b: np.polyfit(a, b, 1)[0]
    first, second = slope(x[:h], y[:h]), slope(x[h:], y[h:])
    return {"coint_beta": float(beta[1]), "coint_alpha": float(beta[0]), "coint_adf": t, "coint_p": p, "cointegrated": float(p <= significance), "spread_std": float(e.std()), "spread_z": float(e[-1] / (e.std() + EPS)), "half_life": float(-math.log(2) / lam) if lam < 0 else math.nan, "hedge_stability": float(1 / (1 + abs(first - second) / (abs(beta[1]) + EPS))), "coint_adf_raw": adf(e, 1, False)[0]}


def wavelet_coherence(x: np.ndarray, y: np.ndarray) -> dict:
    """Coherence and phase in short, middle and long bands of 20 scales."""
    z = lambda v: (v - v.mean()) / (v.std() + EPS)
    scales = np.geomspace(4, max(len(x) / 4, 5), 20)
    a, b = cwt(z(x), scales, "morlet"), cwt(z(y), scales, "morlet")
    cross = (a * b.conj()).sum(axis=1)
    power = np.sqrt((np.abs(a) ** 2).sum(axis=1) * (np.abs(b) ** 2).sum(axis=1)) + 1e-300
    out = {}
    for name, part in zip(("short", "mid", "long"), np.array_split(np.arange(20), 3)):
        out[f"coherence_{name}"] = float((np.abs(cross[part]) / power[part]).mean())
        out[f"phase_{name}"] = float(np.angle(cross[part].sum()))
    return out


def binned_mi(x: np.ndarray, y: np.ndarray, bins: int) -> tuple[float, float]:
    """Mutual information in bits and 2I / (Hx + Hy)."""
    c, *_ = np.histogram2d(x, y, bins)
    p = c / c.sum()
    px, py = p.sum(axis=1), p.sum(axis=0)
    h = lambda q: float(-(q[q > 0] * np.log2(q[q > 0])).sum())
    mi = h(px) + h(py) - h(p.ravel())
    return mi, 2 * mi / (h(px) + h(py)) if h(px) + h(py) > 0 else 0.0


def mi_permutation(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, n: int = 100) -> dict:
    bins = min(20, int(math.sqrt(len(x))))
    mi, nmi = binned_mi(x, y, bins)
    null = np.array([binned_mi(x, rng.permutation(y), bins)[0] for _ in range(n)])
    return {"mutual_information": mi, "normalized_mi": nmi, "mi_p_value": float(((null >= mi).sum() + 1) / (n + 1))}


def te_shuffled(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, bins: int = 8, n: int = 100) -> dict:
    """Transfer entropy x -> y less its mean over shuffled x, and p."""
    cut = lambda v: np.searchsorted(np.unique(np.quantile(v, np.arange(1, bins) / bins)), v)
    a, b = cut(x), cut(y)

    def te(s: np.ndarray) -> float:
        code = (b[1:] * bins + b[:-1]) * bins + s[:-1]
        p = np.bincount(code, minlength=bins**3).reshape(bins, bins, bins) / len(code)
        h = lambda q: -(q[q > 0] * np.log2(q[q > 0])).sum()
        return float(h(p.sum(axis=2).ravel()) + h(p.sum(axis=0).ravel()) - h(p.ravel()) - h(p.sum(axis=(0, 2))))

    seen = te(a)
    null = np.array([te(rng.permutation(a)) for _ in range(n)])
    return {"transfer_entropy": max(seen - null.mean(), 0.0), "te_raw": seen, "te_p_value": float(((null >= seen).sum() + 1) / (n + 1))}


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j]: blocks of doubling width are merged, all of a level at once."""
    n = len(y)
    if n < 2:
        return 0
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    size = 1 << (n - 1).bit_length()
    rank = np.concatenate([rank, np.full(size - n, n, np.int64)])  # what is added stands last and is largest
    total, width = 0, 1
    while width < size:
        pairs = rank.reshape(-1, 2, width)
        base = (np.arange(len(pairs)) * (2 * n + 2))[:, None]
        left, right = (pairs[:, 0] + base).ravel(), (pairs[:, 1] + base).ravel()
        at_most = np.searchsorted(left, right, "right") - np.repeat(np.arange(len(pairs)) * width, width)
        total += int((width - at_most).sum())
        rank = np.sort(pairs.reshape(len(pairs), -1), axis=1).ravel()
        width *= 2
    return total


def order_counts(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """n; S (pairs ordered alike less those ordered unlike); pairs that differ in x; in y.  n log^2 n."""
    n = len(x)
    tied = lambda *c: int(sum(k * (k - 1) // 2 for k in np.unique(np.column_stack(c), axis=0, return_counts=True)[1].tolist()))
    order = np.lexsort((y, x))
    unlike = inversions(y[order])
    every, tx, ty, txy = n * (n - 1) // 2, tied(x), tied(y), tied(x, y)
    return n, every - tx - ty + txy - 2 * unlike, every - tx, every - ty


def lagged_correlations(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, float, int]]:
    """(lag, correlation, rows) of x and y ``lag`` rows later, for -most..most; nan on constants."""
    out = []
    for k in range(-most, most + 1):
        a, b = (x[: len(x) - k], y[k:]) if k >= 0 else (x[-k:], y[: len(y) + k])
        if len(a) < 1:
            continue
        if len(a) < 2:
            out.append((k, math.nan, len(a)))
            continue
        a, b = a - a.mean(), b - b.mean()
        scale = math.sqrt(float(a @ a) * float(b @ b))
        out.append((k, float(a @ b) / scale if scale > 0 else math.nan, len(a)))
    return out


def knn_mi(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information in nats by distances to k-th neighbours (maximum norm), not below 0."""
    n = len(x)
    x, y = ((v - v.mean()) / (v.std() + EPS) for v in (x, y))
    digamma = np.concatenate([[0.0], -0.5772156649015329 + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])
    sx, sy = np.sort(x), np.sort(y)
    total = 0.0
    for a in range(0, n, max(1, (1 << 22) // n)):
        b = min(n, a + max(1, (1 << 22) // n))
        gap = np.maximum(np.abs(x[a:b, None] - x[None, :]), np.abs(y[a:b, None] - y[None, :]))
        gap[np.arange(b - a), np.arange(a, b)] = np.inf
        reach = np.partition(gap, k - 1, axis=1)[:, k - 1]
        within = lambda s, v: np.searchsorted(s, v + reach, "left") - np.searchsorted(s, v - reach, "right")  # noqa: E731 - own value counts in
        nx, ny = np.maximum(within(sx, x[a:b]), 1), np.maximum(within(sy, y[a:b]), 1)
        total += float((digamma[nx] + digamma[ny]).sum())
    return max(float(digamma[k] + digamma[n] - total / n), 0.0)


def forced_stationarity(raw: np.ndarray, cleaned: np.ndarray, alpha: float = 0.05) -> dict:
    """Whether cleaning made a series stationary: ADF p of the raw one above alpha, of the cleaned one below; short series count as not stationary."""
    from geoloom.functions.special import normal_cdf

    def p_value(v: np.ndarray) -> float:
        v = v[np.isfinite(v)]
        if len(v) < 10 or v.std() == 0:
            return 1.0
        t = adf_aic(v)[0]
        if not math.isfinite(t):
            h = len(v) // 2
            a, b = v[:h].var(), v[h:].var()
            return 0.5 if a == 0 or b == 0 or 0.5 < a / b < 2 else 0.1
        # response surface of the test with a constant: piecewise normal of a polynomial in t
        if t > 2.74:
            return 1.0
        if t < -18.83:
            return 0.0
        c = DF_SMALL if t <= -1.61 else DF_LARGE
        return float(normal_cdf(sum(x * t**i for i, x in enumerate(c))))

    a, b = p_value(raw), p_value(cleaned)
    return {"raw_p": a, "cleaned_p": b, "forced": float(a > alpha and b < alpha)}


#: Published approximations of the distribution of the Dickey-Fuller statistic with a constant.  Fixed values.
DF_SMALL = (2.1659, 1.4412, 0.038269)
DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
