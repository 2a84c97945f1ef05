"""Kernels on one series: array in, dict of finite descriptors out.  Series come sorted by date."""

from __future__ import annotations

import math

import numpy as np

from geoloom.functions.special import normal_cdf

EPS = 1e-10


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, residuals, residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, e, float(e @ e)


def adf(v: np.ndarray, lags: int = 4, constant: bool = True) -> tuple[float, int]:
    """t-statistic of the lagged level, and the rows used."""
    d = np.diff(v)
    y = d[lags:]
    x = np.column_stack(([np.ones(len(y))] if constant else []) + [v[lags:-1]] + [d[lags - i : len(d) - i] for i in range(1, lags + 1)])
    k = int(constant)
    if len(y) <= x.shape[1] + 1:
        return math.nan, len(y)
    beta, _, rss = ols(x, y)
    cov = np.linalg.pinv(x.T @ x) * rss / (len(y) - x.shape[1])
    return float(beta[k] / math.sqrt(max(cov[k, k], 1e-300))), len(y)


def adf_aic(v: np.ndarray) -> tuple[float, int]:
    """ADF with the lag up to 4 (n/100)^(1/4) that has the least AIC."""
    best = (math.inf, math.nan, 0)
    most = int(4 * (len(v) / 100) ** 0.25)
    d = np.diff(v)
    for lags in range(most + 1):
        y = d[most:]
        x = np.column_stack([np.ones(len(y)), v[most:-1], *[d[most - i : len(d) - i] for i in range(1, lags + 1)]])
        if len(y) <= x.shape[1] + 1:
            continue
        _, _, rss = ols(x, y)
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * x.shape[1]
        if aic < best[0]:
            best = (aic, adf(v, lags)[0], lags)
    return best[1], best[2]


def stationarity(v: np.ndarray) -> dict:
    t, _ = adf(v)
    p = 2 * normal_cdf(t) if t < 0 else 1.0
    return {"adf_statistic": t, "adf_pvalue": min(p, 1.0), "is_stationary_adf": float(p < 0.05)}


def welch(v: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and averaged power of half-overlapping Hann segments, segment means removed."""
    n = max(8, min(most, len(v) // 4)) if len(v) >= 32 else len(v)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(v) - n + 1, max(n // 2, 1))
    power = np.mean([np.abs(np.fft.rfft((v[s : s + n] - v[s : s + n].mean()) * window)) ** 2 for s in starts], axis=0) / (window @ window)
    power[1 : len(power) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n), power


def spectral(v: np.ndarray, method: str = "welch", n_peaks: int = 5) -> dict:
    d = np.diff(v)
    if method == "welch":
        f, p = welch(d)
    else:
        f, p = np.fft.rfftfreq(len(d)), np.abs(np.fft.rfft(d - d.mean())) ** 2 / len(d)
    f, p = f[1:], p[1:]
    share = p / max(p.sum(), 1e-300)
    peaks = [i for i in range(1, len(p) - 1) if p[i] > p[i - 1] and p[i] >= p[i + 1] and p[i] > np.median(p)]
    peaks = sorted(peaks, key=lambda i: -p[i])[:n_peaks]
    out = {"total_power": float(p.sum()), "spectral_entropy": float(-(share[share > 0] * np.log(share[share > 0])).sum() / math.log(len(p))), "n_peaks": len(peaks)}
    return out | {f"peak_{k + 1}_period": float(1 / f[i]) for k, i in enumerate(peaks)}


def spectrum_shape(v: np.ndarray) -> dict:
    """Detrended spectrum: dominant frequency, bands, centroid, spread, flatness, 85 % roll-off."""
    t = np.arange(len(v))
    x = v - np.polyval(np.polyfit(t, v, 1), t)
    f, p = np.fft.rfftfreq(len(x))[1:], np.abs(np.fft.rfft(x))[1:] ** 2
    total = max(p.sum(), 1e-300)
    top = int(p.argmax())
    centroid = float((f * p).sum() / total)
    bands = {"band_low": f < 0.05, "band_mid_low": (f >= 0.05) & (f < 0.15), "band_mid_high": (f >= 0.15) & (f < 0.3), "band_high": f >= 0.3}
    return {
        "dominant_frequency": float(f[top]), "dominant_period": float(1 / f[top]), "dominant_power": float(p[top] / total), "spectral_centroid": centroid, "spectral_spread": float(math.sqrt(((f - centroid) ** 2 * p).sum() / total)),
        "spectral_flatness": float(np.exp(np.log(p + 1e-300).mean()) / (p.mean() + 1e-300)), "spectral_rolloff": float(f[np.searchsorted(np.cumsum(p), 0.85 * total)]),
    } | {k: float(p[m].sum() / total) for k, m in bands.items()}


def ricker(n: int, a: float) -> np.ndarray:
    x = (np.arange(n) - (n - 1) / 2) / a
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - x**2) * np.exp(-(x**2) / 2)


def cwt(v: np.ndarray, scales: np.ndarray, wavelet: str = "ricker") -> np.ndarray:
    """Continuous wavelet transform by FFT convolution, one row a scale."""
    out = []
    for a in scales:
        n = min(int(10 * a) | 1, len(v))
        if wavelet == "ricker":
            w = ricker(n, a)
        else:
            x = (np.arange(n) - (n - 1) / 2) / a
            w = np.pi**-0.25 * np.exp(1j * 5 * x - x**2 / 2) / math.sqrt(a)
        out.append(np.convolve(v, w[::-1].conj(), "same")[: len(v)])
    return np.array(out)


def wavelet(v: np.ndarray) -> dict:
    x = (v - v.mean()) / (v.std() + EPS)
    scales = np.geomspace(2, max(len(v) / 4, 4), 20)
    energy = (np.abs(cwt(x, scales)) ** 2).sum(axis=1)
    share = energy / max(energy.sum(), 1e-300)
    thirds = np.array_split(share, 3)
    return {
        "wavelet_total_energy": float(energy.sum()), "wavelet_dominant_scale": float(scales[energy.argmax()]), "wavelet_entropy": float(-(share * np.log2(share + 1e-300)).sum()), "wavelet_high_freq": float(thirds[0].sum()),
        "wavelet_mid_freq": float(thirds[1].sum()), "wavelet_low_freq": float(thirds[2].sum()), "wavelet_variance": float(share.var()),
    }


def embed(v: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(v) - (dim - 1) * delay
    return np.column_stack([v[i * delay : i * delay + n] for i in range(dim)])


def _lines(mask: np.ndarray) -> np.ndarray:
    """Lengths of runs of True along the last axis, over all rows."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    return np.nonzero(step == -1)[1] - np.nonzero(step == 1)[1]


def recurrence(v: np.ndarray, dim: int = 3, delay: int = 1, percentile: float = 10.0, shortest: int = 2) -> dict:
    """Recurrence quantification: rate, determinism, laminarity, line statistics."""
    x = embed((v - v.mean()) / (v.std() + EPS), dim, delay)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    n = len(d)
    near = d <= np.percentile(d[np.triu_indices(n, 1)], percentile)
    np.fill_diagonal(near, False)
    diagonals = np.zeros((n - 1, n), bool)
    for k in range(1, n):
        diagonals[k - 1, : n - k] = np.diagonal(near, k)
    diag, vert = _lines(diagonals), _lines(near)
    long, tall = diag[diag >= shortest], vert[vert >= shortest]
    p = np.bincount(long)[shortest:] / max(len(long), 1) if len(long) else np.zeros(0)
    p = p[p > 0]
    return {
        "recurrence_rate": float(near.sum() / (n * (n - 1))), "determinism": float(long.sum() / max(diag.sum(), 1)), "laminarity": float(tall.sum() / max(vert.sum(), 1)), "mean_diagonal": float(long.mean()) if len(long) else 0.0,
        "max_diagonal": float(long.max()) if len(long) else 0.0, "line_entropy": float(-(p * np.log(p)).sum()),
    }


def acf(v: np.ndarray, most: int) -> np.ndarray:
    x = v - v.mean()
    ss = x @ x
    return np.array([1.0] + [float(x[k:] @ x[:-k] / ss) if ss > 0 else 0.0 for k in range(1, most + 1)])


def pacf(v: np.ndarray, most: int) -> np.ndarray:
    """Durbin-Levinson."""
    r = acf(v, most)
    phi = np.zeros((most + 1, most + 1))
    out = np.ones(most + 1)
    for k in range(1, most + 1):
        prev = phi[k - 1, 1:k]
        num, den = r[k] - prev @ r[1:k][::-1], 1 - prev @ r[1:k]
        phi[k, k] = num / den if abs(den) > 1e-12 else 0.0
        phi[k, 1:k] = prev - phi[k, k] * prev[::-1]
        out[k] = phi[k, k]
    return out


def lyapunov(v: np.ndarray, dim: int | None = None, delay: int | None = None, separation: int = 10, steps: int = 20) -> dict:
    """Rosenstein's largest exponent: slope of the mean log divergence of nearest neighbours."""
    x = (v - v.mean()) / (v.std() + EPS)
    n = len(x)
    dim = dim or (2 if n < 200 else 3 if n < 500 else 4)
    if delay is None:
        r = acf(x, min(50, n // 4))
        below = np.flatnonzero(r < 0.5)
        delay = int(below[0]) if len(below) else 1
    e = embed(x, dim, max(delay, 1))
    m = len(e) - steps
    if m < separation + 5:
        return {"lyapunov": math.nan}
    d = np.sqrt(((e[:m, None, :] - e[None, :m, :]) ** 2).sum(axis=2))
    i = np.arange(m)
    d[np.abs(i[:, None] - i[None, :]) < separation] = np.inf
    j = d.argmin(axis=1)
    ok = np.isfinite(d[i, j]) & (d[i, j] > 0)
    curve = []
    for k in range(steps):
        gap = np.sqrt(((e[i[ok] + k] - e[j[ok] + k]) ** 2).sum(axis=1))
        gap = gap[gap > 0]
        curve.append(np.log(gap).mean() if len(gap) else np.nan)
    curve = np.array(curve)
    good = np.isfinite(curve)
    slope = float(np.polyfit(np.arange(steps)[good], curve[good], 1)[0]) if good.sum() > 2 else math.nan
    return {"lyapunov": slope, "chaotic": float(slope > 0.01), "embedding_dim": dim, "delay": delay}


def correlation_dimension(v: np.ndarray, dim: int = 3) -> dict:
    """Slope of ln C(r) on ln r between the 5th and 50th percentile of distances, on at most 500 points."""
    x = embed((v - v.mean()) / (v.std() + EPS), dim, 1)
    x = x[:: max(1, len(x) // 500)]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))[np.triu_indices(len(x), 1)]
    d = np.sort(d[d > 0])
    if len(d) < 20:
        return {"correlation_dimension": math.nan}
    r = np.geomspace(np.percentile(d, 5), np.percentile(d, 50), 10)
    c = np.searchsorted(d, r, "right") / len(d)
    return {"correlation_dimension": float(np.polyfit(np.log(r), np.log(c), 1)[0])}


def template_entropy(v: np.ndarray, m: int = 2, r: float = 0.2, kind: str = "sample") -> float:
    """Sample or approximate entropy within r deviations."""
    tol = r * v.std()
    if kind == "sample":
        n = len(v) - m
        counts = []
        for k in (m, m + 1):
            x = np.column_stack([v[i : i + n] for i in range(k)])
            near = np.abs(x[:, None, :] - x[None, :, :]).max(axis=2) <= tol
            counts.append((near.sum() - n) / 2)
        return float(-math.log(counts[1] / counts[0])) if min(counts) > 0 else math.nan
    phi = []
    for k in (m, m + 1):
        x = np.column_stack([v[i : len(v) - k + 1 + i] for i in range(k)])
        near = np.abs(x[:, None, :] - x[None, :, :]).max(axis=2) <= tol
        phi.append(np.log(near.mean(axis=1)).mean())
    return float(phi[0] - phi[1])


def permutation_entropy(v: np.ndarray, order: int = 3, delay: int = 1) -> float:
    patterns = np.argsort(embed(v, order, delay), axis=1, kind="stable") @ (order ** np.arange(order))
    _, c = np.unique(patterns, return_counts=True)
    p = c / c.sum()
    return float(-(p * np.log2(p)).sum() / math.log2(math.factorial(order)))


def entropies(v: np.ndarray) -> dict:
    counts, _ = np.histogram(v, 20)
    p = counts[counts > 0] / counts.sum()
    out = {f"permutation_entropy_d{k}": permutation_entropy(v, k) for k in (3, 4, 5)}
    out |= {f"sample_entropy_m{m}_r{int(r * 10)}": template_entropy(v, m, r) for m in (2, 3) for r in (0.1, 0.2)}
    power = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
    q = power / max(power.sum(), 1e-300)
    return out | {"approximate_entropy": template_entropy(v, 2, 0.2, "approximate"), "shannon_entropy": float(-(p * np.log2(p)).sum() / math.log2(20)), "spectral_entropy": float(-(q * np.log2(q + 1e-300)).sum() / math.log2(max(len(q), 2)))}


def breakpoint_scan(v: np.ndarray) -> dict:
    """Best two-line split, kept where it leaves less than .8 of one line's residuals.  Prefix sums make it linear."""
    n = len(v)
    least = max(10, n // 10)
    t = np.arange(n, dtype=float)

    def rss(a: np.ndarray) -> np.ndarray:
        """Residual of a line through the first k points, for every k."""
        k = np.arange(1, n + 1)
        x = t - 0.0
        sx, sy, sxx, sxy, syy = (np.cumsum(z) for z in (x, a, x * x, x * a, a * a))
        vx, vy, cv = sxx - sx * sx / k, syy - sy * sy / k, sxy - sx * sy / k
        return np.maximum(vy - np.divide(cv * cv, vx, out=np.zeros(n), where=vx > 0), 0)

    c = v - v.mean()
    head, tail = rss(c), rss(c[::-1])[::-1]
    cuts = np.arange(least, n - least)
    if not len(cuts):
        return {}
    both = head[cuts - 1] + tail[cuts]
    best = int(cuts[both.argmin()])
    if both.min() >= 0.8 * head[-1]:
        return {}
    a, b = np.polyfit(t[:best], v[:best], 1)[0], np.polyfit(t[best:], v[best:], 1)[0]
    return {"trend_breakpoint": best, "trend_slope_before_break": float(a), "trend_slope_after_break": float(b), "trend_slope_change": float(b - a)}


def dmd(x: np.ndarray, rank: int | None = None, energy: float = 0.99, top: int = 10) -> dict:
    """Dynamic mode decomposition of a (variables x time) matrix: eigenvalues, amplitudes, relative reconstruction error."""
    a, b = x[:, :-1], x[:, 1:]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = rank or int(np.searchsorted(np.cumsum(s**2) / max((s**2).sum(), 1e-300), energy) + 1)
    keep = max(1, min(keep, int((s > 1e-12 * s[0]).sum()) or 1))
    u, s, vt = u[:, :keep], s[:keep], vt[:keep]
    values, w = np.linalg.eig(u.T @ b @ vt.T / s)
    modes = b @ vt.T / s @ w
    amplitude, *_ = np.linalg.lstsq(modes, x[:, 0].astype(complex), rcond=None)
    steps = values[:, None] ** np.arange(x.shape[1])[None, :]
    back = (modes * amplitude) @ steps
    error = float(np.linalg.norm(x - back.real) / max(np.linalg.norm(x), 1e-300))
    order = np.argsort(-np.abs(amplitude))[:top]
    phase = np.angle(values)
    moving = phase[np.abs(phase) > 0.01]
    return {"spectral_radius": float(np.abs(values).max()), "mean_magnitude": float(np.abs(values).mean()), "n_stable": int((np.abs(values) < 1).sum()), "n_unstable": int((np.abs(values) > 1).sum()), "dominant_frequency": float(abs(moving[0]) / (2 * np.pi)) if len(moving) else 0.0, "reconstruction_error": error, "rank": keep, "modes": [(float(values[i].real), float(values[i].imag), float(abs(amplitude[i]))) for i in order]}


def dmd_series(v: np.ndarray, rows: int = 10, rank: int = 5) -> dict:
    x = (v - v.mean()) / (v.std() + EPS)
    out = dmd(np.lib.stride_tricks.sliding_window_view(x, len(x) - rows + 1), rank)
    return {f"dmd_{k}": float(v) for k, v in out.items() if k != "modes"}


def phase_surrogate(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    f = np.fft.rfft(v)
    turn = np.exp(2j * np.pi * rng.random(len(f)))
    turn[0] = 1
    if len(v) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(f * turn, len(v))


def block_bootstrap(v: np.ndarray, rng: np.random.Generator, block: int = 10) -> np.ndarray:
    n = -(-len(v) // block)
    starts = rng.integers(0, max(len(v) - block + 1, 1), n)
    return np.concatenate([v[s : s + block] for s in starts])[: len(v)]


NULLS = {"permutation": lambda v, g: g.permutation(v), "block": block_bootstrap, "phase": phase_surrogate, "shift": lambda v, g: np.roll(v, int(g.integers(1, max(len(v), 2))))}


def calibrate(v: np.ndarray, metric, kind: str, rng: np.random.Generator, n: int = 100) -> dict:
    """p = (k + 1) / (n + 1) and effect size against null series; passed at p <= .05 and effect >= 2."""
    seen = metric(v)
    null = np.array([metric(NULLS[kind](v, rng)) for _ in range(n)])
    p = float(((null >= seen).sum() + 1) / (n + 1))
    effect = float((seen - null.mean()) / (null.std() + EPS))
    return {"p_value": p, "effect": effect, "passed": float(p <= 0.05 and effect >= 2)}


def signature(v: np.ndarray, seed: int) -> dict:
    """Diagnostics of the geometry signature that need more than aggregates, the class scores and the dominant class."""
    rng = np.random.default_rng(seed)
    n = len(v)
    t = np.linspace(0, 1, n)
    lo, hi = v.min(), v.max()
    unit = (v - lo) / (hi - lo + EPS)
    # logistic on a grid of midpoints and rates, against a line
    grid = [(m, k) for m in np.linspace(0.1, 0.9, 17) for k in (4, 6, 8, 12, 16, 24)]
    curves = np.array([1 / (1 + np.exp(-k * (t - m))) for m, k in grid])
    curves = np.concatenate([curves, 1 - curves])
    ss = ((unit - unit.mean()) ** 2).sum() + EPS
    centred = curves - curves.mean(axis=1, keepdims=True)
    r2 = ((centred @ (unit - unit.mean())) ** 2 / ((centred**2).sum(axis=1) * ss + EPS)).max()
    line = np.corrcoef(t, unit)[0, 1] ** 2 if hi > lo else 0.0
    saturation = float(np.clip((r2 - line) * 3 + max(r2 - 0.9, 0) * 5, 0, 1))
    p = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
    periodicity = float(np.clip(np.sort(p)[-3:].sum() / (p.sum() + EPS), 0, 1))
    r = acf(v, min(50, n // 2))[1:]
    memory = float(np.clip(np.abs(r).mean(), 0, 1))
    d = np.diff(v)
    kurt = float(((d - d.mean()) ** 4).mean() / (d.var() ** 2 + 1e-300) - 3) if d.std() > 0 else 0.0
    tails = float(np.clip(kurt / 6, 0, 1))
    sq = d**2
    arch = float(np.corrcoef(sq[:-1], sq[1:])[0, 1]) if len(sq) > 3 and sq[:-1].std() > 0 and sq[1:].std() > 0 else 0.0
    clustering = float(np.clip(2 * arch, 0, 1))
    first = abs(float(acf(v, 1)[1]))
    null = [abs(float(acf(phase_surrogate(v, rng), 1)[1])) for _ in range(20)]
    z = (first - np.mean(null)) / (np.std(null) + 1e-6)
    dominance = float(1 / (1 + max(z, 0.0)))
    boots = np.array([rng.choice(v, n).var() for _ in range(20)])
    instability = float(np.clip(boots.std() / (boots.mean() + EPS) * 2, 0, 1))
    flat = float(np.exp(np.log(p + 1e-300).mean()) / (p.mean() + 1e-300))
    scores = {
        "latent_flow": float(np.mean([saturation, line, memory])), "coupled_oscillator": float(np.mean([periodicity, memory * periodicity, 1 - flat])), "reflexive_stochastic": float(np.mean([tails, clustering, instability])),
        "pure_noise": float(np.mean([dominance, flat, 1 - memory])),
    }
    top = sorted(scores.values(), reverse=True)
    confidence = 0.2 if scores["pure_noise"] >= 0.6 else 0.7 * top[0] + 0.3 * (top[0] - top[1])
    return {"saturation": saturation, "periodicity": periodicity, "long_memory": memory, "fat_tails": tails, "volatility_clustering": clustering, "null_dominance": dominance, "surrogate_zscore": float(z), "parameter_instability": instability, "spectral_flatness": flat} | {f"class_{k}": v for k, v in scores.items()} | {"signature_confidence": float(confidence), "dominant_" + max(scores, key=lambda k: (scores[k], k)): 1.0}


def gaussian_hmm(v: np.ndarray, k: int, rounds: int = 100, seed: int = 0) -> dict:
    """Baum-Welch with Gaussian emissions in log space, then the Viterbi path; states ordered by mean."""
    x = (v - v.mean()) / (v.std() + EPS)
    n = len(x)
    means = np.quantile(x, (np.arange(k) + 0.5) / k)
    sd, start, move = np.full(k, max(x.std() / k, 0.1)), np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    last = -math.inf
    for _ in range(rounds):
        b = np.exp(-0.5 * ((x[:, None] - means) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        alpha, scale = np.zeros((n, k)), np.zeros(n)
        a = start * b[0]
        for i in range(n):
            if i:
                a = (alpha[i - 1] @ move) * b[i]
            scale[i] = a.sum()
            alpha[i] = a / scale[i]
        beta = np.ones((n, k))
        for i in range(n - 2, -1, -1):
            beta[i] = move @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        total = np.log(scale).sum()
        start, move = gamma[0], xi / xi.sum(axis=1, keepdims=True)
        w = gamma.sum(axis=0) + EPS
        means = gamma.T @ x / w
        sd = np.sqrt(np.maximum((gamma * (x[:, None] - means) ** 2).sum(axis=0) / w, 1e-4))
        if abs(total - last) < 1e-6 * abs(total):
            break
        last = total
    order = np.argsort(means)
    log_b = -0.5 * ((x[:, None] - means) / sd) ** 2 - np.log(sd)
    log_move = np.log(move + 1e-300)
    best, back = np.log(start + 1e-300) + log_b[0], np.zeros((n, k), int)
    for i in range(1, n):
        step = best[:, None] + log_move
        back[i] = step.argmax(axis=0)
        best = step.max(axis=0) + log_b[i]
    path = np.zeros(n, int)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    rank = np.argsort(order)
    params = k * k + 2 * k - 1
    return {"states": rank[path], "probability": gamma[np.arange(n), path], "means": means[order] * (v.std() + EPS) + v.mean(), "loglik": float(total), "bic": float(params * math.log(n) - 2 * total), "aic": float(2 * params - 2 * total), "transitions": move[np.ix_(order, order)]}


def hmm_states(v: np.ndarray, ks=(2, 3, 4)) -> dict:
    """The number of states with the least BIC."""
    return min((gaussian_hmm(v, k) for k in ks), key=lambda r: r["bic"])


def mean_reversion_ci(d: np.ndarray, radius: float, rng: np.random.Generator, n: int = 200) -> dict:
    """dD = alpha + beta (D - r) with a 95 % bootstrap interval of beta."""
    x, y = d[:-1] - radius, np.diff(d)
    slope = lambda a, b: float(((a - a.mean()) * (b - b.mean())).mean() / max(a.var(), 1e-300))
    beta = slope(x, y)
    boots = []
    for _ in range(n):
        i = rng.integers(0, len(x), len(x))
        boots.append(slope(x[i], y[i]))
    lo, hi = np.percentile(boots, [2.5, 97.5])
    return {"beta": beta, "alpha": float(y.mean() - beta * x.mean()), "beta_low": float(lo), "beta_high": float(hi), "reverting": float(hi < 0)}


def effect_ci(changes: np.ndarray, rng: np.random.Generator, n: int = 100) -> dict:
    """Mean change over its deviation with a 95 % bootstrap interval; ``certain`` if it leaves out zero."""
    effect = lambda v: float(v.mean() / (v.std() + EPS))
    boots = [effect(rng.choice(changes, len(changes))) for _ in range(n)]
    lo, hi = np.percentile(boots, [2.5, 97.5])
    return {"effect": effect(changes), "effect_low": float(lo), "effect_high": float(hi), "certain": float(lo > 0 or hi < 0)}


def stability(v: np.ndarray, metric, rng: np.random.Generator, n: int = 10, share: float = 0.9) -> float:
    """exp(-2 d), d the mean relative change of a metric on contiguous parts of the series."""
    whole = metric(v)
    size = max(int(share * len(v)), 2)
    parts = [metric(v[s : s + size]) for s in rng.integers(0, len(v) - size + 1, n)]
    return float(np.exp(-2 * np.mean([abs(p - whole) / (abs(whole) + EPS) for p in parts])))


# ---- shape of smoothed derivatives, crossings and drift


def smoothed(v: np.ndarray, size: int) -> np.ndarray:
    """Running mean of ``size`` values, the series mirrored at its ends; an even size looks one further back."""
    left, right = size // 2, size - size // 2 - 1
    padded = np.concatenate([v[:left][::-1], v, v[len(v) - right :][::-1]]) if size > 1 else v
    sums = np.concatenate([[0.0], np.cumsum(padded)])
    return (sums[size:] - sums[:-size]) / size


def sign_changes(x: np.ndarray) -> tuple[int, int]:
    """Changes among the signs of the non-zero values, and how many changes there could be."""
    s = np.sign(x)
    s = s[s != 0]
    return int((np.diff(s) != 0).sum()), max(len(s) - 1, 0)


def shape(v: np.ndarray) -> dict:
    """Derivative shape, monotonicity of the smoothed series, crossings of the mean and their regularity, drift: scores and their metrics."""
    n = len(v)
    slope = np.diff(smoothed(v, max(5, n // 20)))
    rising = float((slope > 0).mean())
    half = len(slope) // 2
    slowing = np.abs(slope[half:]).mean() < 0.8 * np.abs(slope[:half]).mean()
    peak = int(np.abs(slope).argmax())
    inner = 0.1 * len(slope) < peak < 0.9 * len(slope)
    form = 0.85 if rising > 0.7 and slowing else 0.7 if rising < 0.3 and slowing else 0.75 if inner else 0.5 if slowing else 0.2
    changes, most = sign_changes(np.diff(smoothed(v, max(7, n // 15))))
    steady = 1 - changes / most if most else 0.5
    steadiness = 0.5 if not most else 0.95 if steady > 0.85 else 0.8 if steady > 0.7 else 0.6 if steady > 0.5 else 0.3
    crossed = np.flatnonzero(np.diff(np.sign(v - v.mean())) != 0)
    rate = len(crossed) / (n / 2)
    gaps = np.diff(crossed)
    regular = float(1 / (1 + gaps.std() / (gaps.mean() + 1e-6))) if len(crossed) > 2 else 0.0
    swing = regular * 0.8 + 0.2 * (1 - abs(rate - 0.7)) if 0.3 < rate < 1.5 else regular * 0.3
    drift = abs(v[-1] - v[0]) / (n * (np.diff(v).std() + EPS)) * math.sqrt(n)
    return {
        "derivative_shape": form, "rising_share": rising, "decelerating": float(slowing), "interior_peak": float(inner), "smooth_monotonicity": steady, "smooth_monotonicity_score": steadiness, "mean_crossing_rate": rate, "crossing_regularity": regular,
        "zero_crossings": float(np.clip(swing, 0, 1)), "normalised_drift": float(drift), "drift_noise_score": float(np.clip(2 * (1 - normal_cdf(drift)), 0, 1)),
    }


# ---- counts along sorted values


def near_pairs(v: np.ndarray, tol: float) -> int:
    """Pairs of values at most ``tol`` apart."""
    s = np.sort(v)
    return int((np.searchsorted(s, s + tol, "right") - np.arange(len(s)) - 1).sum())


def near_templates(v: np.ndarray, m: int, tol: float, block: int = 1 << 20) -> tuple[int, int]:
    """Pairs of runs whose first m, and whose m + 1 values lie within ``tol``; candidates share the range of their first value."""
    x = np.column_stack([v[i : len(v) - m + i] for i in range(m + 1)])
    x = x[np.argsort(x[:, 0], kind="stable")]
    upto = np.searchsorted(x[:, 0], x[:, 0] + tol * (1 + 1e-12) + 1e-300, "right")
    ahead = np.maximum(upto - np.arange(len(x)) - 1, 0)
    ends = np.concatenate([[0], np.cumsum(ahead)])
    near = more = at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + block, "right")) - 1)
        i = np.repeat(np.arange(at, to), ahead[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[at:to] - ends[at], ahead[at:to])
        gap = np.abs(x[i] - x[j])
        ok = (gap[:, :m] <= tol).all(axis=1)
        near += int(ok.sum())
        more += int((ok & (gap[:, m] <= tol)).sum())
        at = to
    return near, more
