"""Kernels on small matrices: eigen structure, linkage, k-means, cluster detectors, robust covariance.

Matrices are indicators x indicators or windows x features, never the rows of a
corpus.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-10


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending and eigenvectors, each with its largest entry positive."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    w, v = w[::-1], v[:, ::-1]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return w, v * np.where(sign == 0, 1, sign)


def dimensions(w: np.ndarray) -> dict:
    """The four effective dimensions of a spectrum, shares of the first component, and the gap."""
    w = np.maximum(w, 0)
    p = w / max(w.sum(), 1e-300)
    cum = np.cumsum(p)
    q = p[p > 0]
    return {"dim_90": int(np.searchsorted(cum, 0.9 - 1e-12) + 1), "dim_95": int(np.searchsorted(cum, 0.95 - 1e-12) + 1), "participation_ratio": float(1 / (p**2).sum()), "effective_rank": float(np.exp(-(q * np.log(q)).sum())), "gfm": float(p[0]), "eigen_gap": float(w[0] / w[1]) if len(w) > 1 and w[1] > 0 else math.inf}


def remove_first(m: np.ndarray, k: int = 1) -> np.ndarray:
    """Correlation matrix without its first k factors, scaled back to a unit diagonal."""
    w, v = eigen(m)
    r = m - (v[:, :k] * w[:k]) @ v[:, :k].T
    d = np.sqrt(np.maximum(np.diag(r), EPS))
    return np.clip(r / np.outer(d, d), -1, 1)


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomeration by Lance-Williams: rows (a, b, height, size); ward takes Euclidean distances."""
    n = len(d)
    d = (d.astype(float) ** 2) if method == "ward" else d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        flat = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(flat.argmin(), flat.shape)
        i, j = min(i, j), max(i, j)
        height = d[i, j]
        out.append((min(label[i], label[j]), max(label[i], label[j]), math.sqrt(height) if method == "ward" else height, size[i] + size[j]))
        others = alive.copy()
        others[[i, j]] = False
        a, b = d[i, others], d[j, others]
        if method == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "single":
            new = np.minimum(a, b)
        else:
            k = size[others]
            new = ((size[i] + k) * a + (size[j] + k) * b - k * height) / (size[i] + size[j] + k)
        d[i, others] = d[others, i] = new
        alive[j] = False
        size[i] += size[j]
        label[i] = n + step
    return np.array(out)


def cut(tree: np.ndarray, n: int, height: float | None = None, k: int | None = None) -> np.ndarray:
    """Flat labels below a height or for k clusters, numbered by first member."""
    root = list(range(2 * n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    merges = n - k if k is not None else int((tree[:, 2] <= height).sum())
    for step in range(max(merges, 0)):
        root[find(int(tree[step, 0]))] = root[find(int(tree[step, 1]))] = n + step
    return number([find(i) for i in range(n)])


def number(labels) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen)) for x in labels])


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """k-means++ starts, Lloyd rounds; labels, centres, inertia."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            lab = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = float(((x - c[lab]) ** 2).sum())
        if best is None or inertia < best[2] - 1e-12:
            best = (number(lab), c, inertia)
    return best


def silhouette(d: np.ndarray, lab: np.ndarray) -> float:
    """Mean silhouette on a distance matrix; members of single clusters count 0."""
    ks = np.unique(lab)
    if len(ks) < 2 or len(ks) >= len(lab):
        return -1.0
    mean = np.stack([d[:, lab == k].sum(axis=1) for k in ks], axis=1)
    size = np.array([(lab == k).sum() for k in ks])
    own = np.searchsorted(ks, lab)
    i = np.arange(len(lab))
    a = mean[i, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[i, own] = np.inf
    b = other.min(axis=1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), EPS), 0)
    return float(s.mean())


def calinski_harabasz(x: np.ndarray, lab: np.ndarray) -> float:
    ks = np.unique(lab)
    within = sum(((x[lab == k] - x[lab == k].mean(axis=0)) ** 2).sum() for k in ks)
    between = sum((lab == k).sum() * ((x[lab == k].mean(axis=0) - x.mean(axis=0)) ** 2).sum() for k in ks)
    return float(between / max(within, EPS) * (len(x) - len(ks)) / max(len(ks) - 1, 1))


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def best_clusters(x: np.ndarray, method: str = "kmeans", most: int = 10, k: int | None = None) -> dict:
    """Labels with the best silhouette over 2..most clusters, or for a given k."""
    d = distances(x)
    tree = linkage(d, "ward") if method != "kmeans" else None
    best = None
    for c in [k] if k else range(2, min(most, len(x) - 1) + 1):
        lab = kmeans(x, c)[0] if method == "kmeans" else cut(tree, len(x), k=c)
        s = silhouette(d, lab)
        if best is None or s > best["silhouette"] + 1e-12:
            best = {"labels": lab, "k": int(lab.max()) + 1, "silhouette": s, "calinski_harabasz": calinski_harabasz(x, lab)}
    return best or {"labels": np.zeros(len(x), int), "k": 1, "silhouette": -1.0, "calinski_harabasz": 0.0}


def _components(adjacent: np.ndarray) -> np.ndarray:
    lab = np.arange(len(adjacent))
    linked = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(linked, lab[None, :], len(lab)).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return number(lab)
        lab = new


def eigengap(s: np.ndarray, most: int | None = None) -> np.ndarray:
    """Spectral clustering with as many clusters as the largest gap of the normalised Laplacian says."""
    a = np.abs(s) - np.diag(np.diag(np.abs(s)))
    d = 1 / np.sqrt(np.maximum(a.sum(axis=1), EPS))
    w, v = np.linalg.eigh(np.eye(len(a)) - d[:, None] * a * d[None, :])
    top = min(most or 10, len(w) - 1)
    k = int(np.diff(w[: top + 1]).argmax()) + 1
    if k == 1:
        return np.zeros(len(a), int)
    rows = v[:, :k]
    return kmeans(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), EPS), k)[0]


def dendrogram_gap(d: np.ndarray) -> np.ndarray:
    """Average linkage cut in the largest gap between merges."""
    if len(d) < 3:
        return np.zeros(len(d), int)
    tree = linkage(d)
    i = int(np.diff(tree[:, 2]).argmax())
    return cut(tree, len(d), k=len(d) - i - 1)


def modularity(a: np.ndarray, lab: np.ndarray, resolution: float = 1.0) -> float:
    deg = a.sum(axis=1)
    m2 = deg.sum()
    if m2 <= 0:
        return 0.0
    same = lab[:, None] == lab[None, :]
    return float(((a - resolution * np.outer(deg, deg) / m2) * same).sum() / m2)


def modularity_clusters(s: np.ndarray, most: int = 9) -> np.ndarray:
    """Spectral partitions into 2..most parts, the one with the best Q."""
    a = np.abs(s) - np.diag(np.diag(np.abs(s)))
    _, v = eigen(a)
    best = (modularity(a, np.zeros(len(a), int)), np.zeros(len(a), int))
    for k in range(2, min(most, len(a) - 1) + 1):
        lab = kmeans(v[:, :k], k)[0]
        q = modularity(a, lab)
        if q > best[0] + 1e-12:
            best = (q, lab)
    return best[1]


def gravitation(s: np.ndarray, steps: int = 100, dt: float = 0.1, merge: float = 0.1, damping: float = 0.9) -> np.ndarray:
    """Classical scaling, then attraction by similarity and repulsion at short range, masses by total similarity; what ends within ``merge`` is one cluster."""
    n = len(s)
    apart = 1 - np.clip(s, 0, 1)
    j = np.eye(n) - 1 / n
    w, v = eigen(-0.5 * j @ (apart - np.diag(np.diag(apart))) ** 2 @ j)
    x = v[:, :2] * np.sqrt(np.maximum(w[:2], 0))
    speed = np.zeros_like(x)
    mass = s.sum(axis=1)
    mass = mass / max(mass.max(), EPS)
    pull = s - np.diag(np.diag(s))
    for _ in range(steps):
        gap = x[None, :, :] - x[:, None, :]
        r = np.sqrt((gap**2).sum(axis=2))
        far = r > 1e-6
        force = np.where(far, pull / (r + 0.1) - np.where(r < 0.2, 0.01 / (r**2 + 0.01), 0), 0) * mass[None, :]
        unit = np.divide(gap, r[:, :, None], out=np.zeros_like(gap), where=far[:, :, None])
        speed = damping * speed + dt * (force[:, :, None] * unit).sum(axis=1)
        x = x + dt * speed
    return _components(distances(x) < merge)


def persistent(d: np.ndarray, thresholds: int = 50) -> np.ndarray:
    """Components over a range of thresholds; the number of clusters that lasts longest."""
    levels = np.linspace(d[d > 0].min() if (d > 0).any() else 0, d.max(), thresholds)
    labs = [_components(d <= t) for t in levels]
    ks = np.array([lab.max() + 1 for lab in labs])
    inner = [k for k in np.unique(ks) if 1 < k < len(d)]
    if not inner:
        return np.zeros(len(d), int)
    k = max(inner, key=lambda k: ((ks == k).sum(), -k))
    return labs[int(np.flatnonzero(ks == k)[(ks == k).sum() // 2])]


def ensemble(s: np.ndarray) -> dict:
    """Five detectors, co-occurrence above one half, confidence, density, separation."""
    d = np.sqrt(np.maximum(2 * (1 - s), 0))
    np.fill_diagonal(d, 0)
    found = {"eigengap": eigengap(s), "dendrogram": dendrogram_gap(d), "modularity": modularity_clusters(s), "gravitation": gravitation(s), "persistence": persistent(d)}
    together = np.mean([lab[:, None] == lab[None, :] for lab in found.values()], axis=0)
    lab = _components(together > 0.5)
    same = (lab[:, None] == lab[None, :]) & ~np.eye(len(lab), dtype=bool)
    apart = lab[:, None] != lab[None, :]
    agree = np.where(same, together, 1 - together)[~np.eye(len(lab), dtype=bool)].mean() if len(lab) > 1 else 1.0
    return {"labels": lab, "k": int(lab.max()) + 1, "confidence": float(agree), "density": float(np.abs(s)[same].mean()) if same.any() else 0.0, "separation": float(1 - np.abs(s)[apart].mean()) if apart.any() else 0.0, "methods": found}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two partitions on pairs."""
    i, j = np.triu_indices(len(a), 1)
    x, y = a[i] == a[j], b[i] == b[j]
    return float((x & y).sum() / max((x | y).sum(), 1))


def mcd(x: np.ndarray, support: float = 0.75, starts: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FAST-MCD location and covariance; median and covariance where it fails."""
    n, p = x.shape
    h = max(int(support * n), p + 1)
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        pick = rng.choice(n, min(p + 1, n), replace=False)
        for _ in range(10):
            c, v = x[pick].mean(axis=0), np.cov(x[pick].T).reshape(p, p) + 1e-9 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.pinv(v), x - c)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        det = float(np.linalg.slogdet(np.cov(x[pick].T).reshape(p, p) + 1e-9 * np.eye(p))[1])
        if best is None or det < best[0]:
            best = (det, pick)
    if best is None or not math.isfinite(best[0]):
        return np.median(x, axis=0), np.cov(x.T).reshape(p, p)
    core = x[best[1]]
    return core.mean(axis=0), np.cov(core.T).reshape(p, p)


def home_region(x: np.ndarray, coverage: float = 0.8, robust: bool = True) -> dict:
    """Centre, precision and the radius that holds ``coverage`` of the points; needs 100 of them."""
    if len(x) < 100:
        raise ValueError("a home region needs 100 samples")
    c, v = mcd(x) if robust else (np.median(x, axis=0), np.cov(x.T).reshape(x.shape[1], -1))
    precision = np.linalg.inv(v + 1e-6 * np.eye(len(c)))
    d = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - c, precision, x - c), 0))
    return {"centre": c, "precision": precision, "radius": float(np.percentile(d, 100 * coverage)), "distances": d}


def mahalanobis_pairs(m: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """sqrt |(e_i - e_j)' M^-1 (e_i - e_j)| of a covariance matrix; ridged where singular."""
    try:
        inv = np.linalg.inv(m)
        if not np.isfinite(inv).all() or np.linalg.cond(m) > 1e12:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        inv = np.linalg.inv(m + ridge * np.eye(len(m)))
    g = np.diag(inv)
    return np.sqrt(np.abs(g[:, None] + g[None, :] - 2 * inv))


def residual_velocity(axes: np.ndarray, values: np.ndarray, velocity: np.ndarray, metric: str = "natural") -> float:
    """Length of a velocity off the plane of the principal axes, under the natural, diagonal or Euclidean metric."""
    off = velocity - axes.T @ (axes @ velocity)
    if metric == "euclidean":
        return float(np.linalg.norm(off))
    scale = np.maximum(values, EPS)
    inside = axes @ velocity
    if metric == "diagonal":
        return float(np.sqrt((off**2 / scale.mean()).sum()))
    return float(np.sqrt((off**2).sum() / scale[-1] + 1e-3 * (inside**2 / scale).sum()))
