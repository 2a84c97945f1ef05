"""Runs numpy kernels on groups through Arrow: one shuffle, all kernels of a group fused.

Groups are series or windows of series; their size is the window's, not the
table's.  Rows are sorted by date in the kernel, as groups come unordered.
Random kernels are seeded by a hash of the group's key and the kernel's name,
so results do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geoloom.kernels import cohort, pair, series


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


#: name -> (least observations, kernel(values, seed)).
SERIES: dict[str, tuple[int, Callable]] = {
    "geometry": (30, series.signature), "entropy": (50, lambda v, s: series.entropies(v)), "wavelet": (64, lambda v, s: series.wavelet(v)), "dmd": (63, lambda v, s: series.dmd_series(v)), "spectral": (64, lambda v, s: series.spectral(v)),
    "spectrum": (64, lambda v, s: series.spectrum_shape(v)), "trend_break": (50, lambda v, s: series.breakpoint_scan(v)), "recurrence": (100, lambda v, s: series.recurrence(v[:: max(1, len(v) // 100)])), "rqa": (50, lambda v, s: series.recurrence(v)),
    "lyapunov": (200, lambda v, s: series.lyapunov(v) | series.correlation_dimension(v)), "stationarity": (50, lambda v, s: series.stationarity(v)), "pacf": (50, lambda v, s: {f"pacf_lag{k}": float(x) for k, x in enumerate(series.pacf(v, 10)) if k}),
    "mean_reversion": (30, lambda v, s: series.mean_reversion_ci(v, float(np.percentile(v, 80)), np.random.default_rng(s))),
    "effect": (10, lambda v, s: series.effect_ci(np.diff(v), np.random.default_rng(s))), "stability": (50, lambda v, s: {"stability_volatility": series.stability(v, lambda x: float(np.diff(x).std()), np.random.default_rng(s))}),
    "shape": (50, lambda v, s: series.shape(v)),
    "null_calibration": (50, lambda v, s: series.calibrate(v, lambda x: abs(series.acf(x, 1)[1]), "permutation", np.random.default_rng(s), 99)),
}
PAIRS: dict[str, tuple[int, Callable]] = {
    "granger": (50, lambda x, y, s: pair.granger_both(x, y)), "granger_fixed": (50, lambda x, y, s: dict(zip(("f_4", "p_4"), pair.granger(x, y, 4)))), "dtw": (30, lambda x, y, s: pair.dtw(x, y)), "cointegration": (100, lambda x, y, s: pair.cointegration(x, y)),
    "coherence": (64, lambda x, y, s: pair.wavelet_coherence(x, y)), "mutual_information": (50, lambda x, y, s: pair.mi_permutation(x, y, np.random.default_rng(s))), "transfer_entropy": (50, lambda x, y, s: pair.te_shuffled(x, y, np.random.default_rng(s))),
    "knn_mi": (50, lambda x, y, s: {"knn_mutual_information": pair.knn_mi(x, y)}), "forced_stationarity": (10, lambda x, y, s: pair.forced_stationarity(x, y)),
}


# ---- Arrow groups


def arrow_groups(rows: DataFrame, keys, schema: str, f: Callable) -> DataFrame:
    """``f(key values, sorted pyarrow table)`` -> list of rows (without the keys); ``schema`` names their columns.  One shuffle on the keys."""
    import pyarrow as pa

    fields = [rows.schema[k] for k in keys]
    whole = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in fields) + ", " + schema
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(key, table):
        values = tuple(k.as_py() for k in key)
        found = f(values, table)
        columns = list(zip(*[(*values, *r) for r in found])) or [()] * len(names)
        kinds = [table.schema.field(k).type for k in keys] + [_ARROW[c.split()[1]]() for c in schema.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return rows.groupBy(*keys).applyInArrow(run, whole)


def _arrow_types() -> dict:
    import pyarrow as pa

    return {"long": pa.int64, "int": pa.int32, "double": pa.float64, "string": pa.string, "boolean": pa.bool_}


_ARROW = _arrow_types()


def arrow_rows(panel: DataFrame, keys, schema: str, f: Callable) -> DataFrame:
    """``f(values by date)`` -> one row a series."""

    def one(_, table):
        return [f(table.sort_by("date")["value"].to_numpy())]

    return arrow_groups(panel.select(*keys, "date", "value"), keys, schema, one)


def order_counts(rows: DataFrame, keys) -> DataFrame:
    """(keys, x, y) -> n, s, nx, ny: pairs ordered alike less unlike, and pairs that differ in x and in y."""
    return arrow_groups(rows, keys, "n long, s long, nx long, ny long", lambda _, t: [pair.order_counts(t["x"].to_numpy(), t["y"].to_numpy())])


def _finite(found: dict) -> list[tuple[str, float]]:
    return [(k, float(v)) for k, v in found.items() if isinstance(v, (int, float, np.floating, np.integer)) and math.isfinite(v)]


def series_descriptors(panel: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ("indicator_id",), run: str = "run") -> DataFrame:
    """(keys, kernel, dimension, value) of all kernels over each series; what isn't finite is left out, what fails is a row with dimension ``skipped``."""
    chosen = {k: SERIES[k] for k in (names or SERIES)}
    fields = [panel.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kernel string, dimension string, value double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("date")["value"].to_numpy(float)
        v = v[np.isfinite(v)]
        out = []
        for name, (least, kernel) in chosen.items():
            if len(v) < least or v.std() == 0:
                out.append((*key, name, "skipped", float(len(v))))
                continue
            try:
                out += [(*key, name, d, x) for d, x in _finite(kernel(v, seed_of(run, *key, name)))]
            except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                out.append((*key, name, "skipped", float(len(v))))
        return pd.DataFrame(out, columns=[*keys, "kernel", "dimension", "value"])

    return panel.select(*keys, "date", "value").groupBy(*keys).applyInPandas(run_group, schema)


def pair_descriptors(pairs: DataFrame, names: list[str] | None = None, extra: tuple[str, ...] = (), run: str = "run") -> DataFrame:
    """(extra, id_1, id_2, date, x, y) -> (.., kernel, dimension, value); aligned by date."""
    chosen = {k: PAIRS[k] for k in (names or PAIRS)}
    keys = (*extra, "id_1", "id_2")
    fields = [pairs.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kernel string, dimension string, value double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        ok = np.isfinite(x) & np.isfinite(y)
        x, y = x[ok], y[ok]
        out = []
        for name, (least, kernel) in chosen.items():
            if len(x) < least or x.std() == 0 or y.std() == 0:
                out.append((*key, name, "skipped", float(len(x))))
                continue
            try:
                out += [(*key, name, d, v) for d, v in _finite(kernel(x, y, seed_of(run, *key, name)))]
            except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                out.append((*key, name, "skipped", float(len(x))))
        return pd.DataFrame(out, columns=[*keys, "kernel", "dimension", "value"])

    return pairs.select(*keys, "date", "x", "y").groupBy(*keys).applyInPandas(run_group, schema)


def hidden_states(panel: DataFrame, keys: tuple[str, ...] = ("indicator_id",)) -> DataFrame:
    """(keys, date, state, probability): Viterbi path of the Gaussian HMM with the best BIC of 2..4 states; 126 values at least."""
    fields = [panel.schema[k] for k in (*keys, "date")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", state int, probability double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values("date")
        if len(rows) < 126 or rows["value"].std() == 0:
            return pd.DataFrame({**{k: [] for k in keys}, "date": [], "state": [], "probability": []})
        found = series.hmm_states(rows["value"].to_numpy(float))
        out = rows[[*keys, "date"]].copy()
        out["state"], out["probability"] = found["states"].astype("int32"), found["probability"]
        return out

    return panel.select(*keys, "date", "value").groupBy(*keys).applyInPandas(run_group, schema)


def wavelet_table(panel: DataFrame, keys: tuple[str, ...] = ("indicator_id",)) -> DataFrame:
    """(keys, scale, energy)."""
    fields = [panel.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", scale double, energy double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("date")["value"].to_numpy(float)
        v = v[np.isfinite(v)]
        if len(v) < 64:
            return pd.DataFrame({**{k: [] for k in keys}, "scale": [], "energy": []})
        scales = np.geomspace(2, len(v) / 4, 20)
        energy = (np.abs(series.cwt((v - v.mean()) / (v.std() + 1e-10), scales)) ** 2).sum(axis=1)
        return pd.DataFrame({**{k: [x] * 20 for k, x in zip(keys, key)}, "scale": scales, "energy": energy})

    return panel.select(*keys, "date", "value").groupBy(*keys).applyInPandas(run_group, schema)


# ---- cohorts: one small matrix a window


def _matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    ids = sorted({*rows["id_1"], *rows["id_2"]})
    at = {k: i for i, k in enumerate(ids)}
    m = np.eye(len(ids))
    for a, b, r in zip(rows["id_1"], rows["id_2"], rows["corr"]):
        if r == r:
            m[at[a], at[b]] = m[at[b], at[a]] = r
    return ids, m


def eigen_structure(corr: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Per window of an edge list: spectrum, four effective dimensions, density, and each indicator's loading on PC1 and residual."""
    fields = [corr.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", indicator_id string, dimension string, value double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _matrix(rows)
        w, v = cohort.eigen(m)
        upper = np.abs(m[np.triu_indices(len(m), 1)])
        out = [(*key, None, d, x) for d, x in _finite(cohort.dimensions(w) | {"mean_abs_corr": float(upper.mean()), "density_60": float((upper >= 0.6).mean())})]
        out += [(*key, None, f"variance_explained_{i + 1}", float(x / w.sum())) for i, x in enumerate(w[:10])]
        for j in range(min(5, len(ids))):
            out += [(*key, i, f"loading_pc{j + 1}", float(v[k, j])) for k, i in enumerate(ids)]
        out += [(*key, i, "isolation", float(1 - (np.abs(m[k]).sum() - 1) / max(len(ids) - 1, 1))) for k, i in enumerate(ids)]
        out += [(*key, i, "pc1_residual", float(1 - w[0] * v[k, 0] ** 2)) for k, i in enumerate(ids)]
        return pd.DataFrame(out, columns=[*keys, "indicator_id", "dimension", "value"])

    return corr.select(*keys, "id_1", "id_2", "corr").groupBy(*keys).applyInPandas(run_group, schema)


def clusters(corr: DataFrame, method: str = "ensemble", keys: tuple[str, ...] = ("window_id",), remove_pc1: bool = False) -> DataFrame:
    """(keys, indicator_id, cluster, k, confidence) by the ensemble, one of its detectors, k-means or ward on correlation rows."""
    fields = [corr.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", indicator_id string, cluster int, k int, confidence double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _matrix(rows)
        if remove_pc1 and len(ids) > 2:
            m = cohort.remove_first(m)
        if len(ids) < 3:
            lab, confidence = np.zeros(len(ids), int), 1.0
        elif method in ("kmeans", "ward"):
            found = cohort.best_clusters(m, method)
            lab, confidence = found["labels"], found["silhouette"]
        else:
            found = cohort.ensemble(m)
            lab, confidence = (found["labels"], found["confidence"]) if method == "ensemble" else (found["methods"][method], 1.0)
        return pd.DataFrame({**{k: [x] * len(ids) for k, x in zip(keys, key)}, "indicator_id": ids, "cluster": lab.astype("int32"), "k": np.int32(lab.max() + 1), "confidence": float(confidence)})

    return corr.select(*keys, "id_1", "id_2", "corr").groupBy(*keys).applyInPandas(run_group, schema)


def cohort_views(corr: DataFrame, keys: tuple[str, ...] = ("window_id",), threshold: float = 0.6) -> DataFrame:
    """Centrality (mean |r|) and first loading of each indicator seen from the full system, with its first factor removed, and within its cluster (components at the threshold), and how far the views diverge."""

    def views(_, table):
        ids, m = _matrix(table.to_pandas())
        n = len(ids)
        lab = cohort._components(np.abs(m) >= threshold)
        central = lambda x: (np.abs(x).sum(axis=1) - 1) / max(len(x) - 1, 1)
        rest = cohort.remove_first(m) if n > 2 else m
        full, residual, within = central(m), central(rest), np.zeros(n)
        for c in range(lab.max() + 1):
            own = np.flatnonzero(lab == c)
            within[own] = central(m[np.ix_(own, own)]) if len(own) > 1 else 0.0
        first, after = cohort.eigen(m)[1][:, 0], cohort.eigen(rest)[1][:, 0]
        return [(i, int(lab[k]), int((lab == lab[k]).sum()), float(full[k]), float(residual[k]), float(within[k]), float(first[k]), float(after[k]), float(abs(full[k] - residual[k])), float(abs(full[k] - within[k]))) for k, i in enumerate(ids)]

    columns = "indicator_id string, cluster int, cluster_size int, full_centrality double, residual_centrality double, within_centrality double, full_loading double, residual_loading double, residual_divergence double, within_divergence double"
    return arrow_groups(corr.select(*keys, "id_1", "id_2", "corr"), keys, columns, views)


def decontamination(corr: DataFrame, keys: tuple[str, ...] = ("window_id",), limit: float = 0.7, hidden_ratio: float = 2.0) -> DataFrame:
    """Whether one factor dominates (mean |r| or PC1 share above the limit), and what shows once it is removed."""
    fields = [corr.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", contaminated boolean, pc1_share double, dim_before double, dim_after double, cohorts_before int, cohorts_after int, density_before double, density_after double, hidden boolean"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, m = _matrix(rows)
        upper = np.triu_indices(len(m), 1)
        w = np.maximum(cohort.eigen(m)[0], 0)
        r = cohort.remove_first(m)
        parts = lambda x: int(cohort._components(np.abs(x) >= 0.3).max() + 1)
        pc1 = float(w[0] / w.sum())
        before, after = cohort.dimensions(w)["participation_ratio"], cohort.dimensions(cohort.eigen(r)[0])["participation_ratio"]
        out = (*key, bool(np.abs(m[upper]).mean() > limit or pc1 > limit), pc1, before, after, parts(m), parts(r), float((np.abs(m[upper]) >= 0.3).mean()), float((np.abs(r[upper]) >= 0.3).mean()), bool(after / before >= hidden_ratio))
        return pd.DataFrame([out], columns=[*keys, "contaminated", "pc1_share", "dim_before", "dim_after", "cohorts_before", "cohorts_after", "density_before", "density_after", "hidden"])

    return corr.select(*keys, "id_1", "id_2", "corr").groupBy(*keys).applyInPandas(run_group, schema)


def mahalanobis(cov: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """(keys, id_1, id_2, mahalanobis) from an edge list of correlations."""
    fields = [cov.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", id_1 string, id_2 string, mahalanobis double"

    def run_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = _matrix(rows)
        d = cohort.mahalanobis_pairs(m)
        i, j = np.triu_indices(len(ids), 1)
        return pd.DataFrame({**{k: [x] * len(i) for k, x in zip(keys, key)}, "id_1": [ids[a] for a in i], "id_2": [ids[b] for b in j], "mahalanobis": d[i, j]})

    return cov.select(*keys, "id_1", "id_2", "corr").groupBy(*keys).applyInPandas(run_group, schema)


def panel_modes(cut: DataFrame, keys: tuple[str, ...] = ("window_id",), delay: int = 1) -> DataFrame:
    """(keys, dimension, value): dynamic modes of all indicators of a window together, z-scored, delay-embedded where ``delay`` is over 1."""

    def modes(_, table):
        x = _wide(table)
        if x.shape[1] < 3 * delay + 2 or not len(x):
            return [("skipped", float(x.shape[1]))]
        x = np.vstack([x[:, delay - 1 - d : x.shape[1] - d] for d in range(delay)])
        found = series.dmd(x)
        out = _finite(found)
        for i, (real, imaginary, amplitude) in enumerate(found["modes"]):
            value = complex(real, imaginary)
            out += [(f"mode_{i + 1}_magnitude", abs(value)), (f"mode_{i + 1}_frequency", abs(math.atan2(imaginary, real)) / (2 * math.pi)), (f"mode_{i + 1}_amplitude", amplitude)]
        return out

    return arrow_groups(cut.select(*keys, "indicator_id", "date", "value"), keys, "dimension string, value double", modes)


def _wide(table) -> np.ndarray:
    """Indicators x dates that all have, z-scored; constant ones are left out."""
    rows = table.to_pandas().pivot_table(index="date", columns="indicator_id", values="value").dropna().sort_index()
    x = rows.to_numpy(float).T
    x = x[x.std(axis=1) > 0] if x.size else x
    return (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True) if x.size else x


def panel_states(cut: DataFrame, keys: tuple[str, ...] = ("window_id",), n_states: int = 3) -> DataFrame:
    """(keys, date, state, probability): states of all indicators of a window together by k-means on z-scores; probabilities by inverse distance; states in order of their first date."""
    import pyarrow as pa

    fields = [cut.schema[k] for k in (*keys, "date")]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in fields) + ", state int, probability double"

    def states(key, table):
        rows = table.to_pandas().pivot_table(index="date", columns="indicator_id", values="value").dropna().sort_index()
        x = rows.to_numpy(float)
        kinds = [table.schema.field(k).type for k in (*keys, "date")] + [pa.int32(), pa.float64()]
        names = [*keys, "date", "state", "probability"]
        if len(x) < n_states:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-10)
        lab, _, _ = cohort.kmeans(x, n_states)
        centres = np.array([x[lab == j].mean(axis=0) for j in range(lab.max() + 1)])
        near = 1 / (np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(axis=2)) + 1e-10)
        chance = near[np.arange(len(x)), lab] / near.sum(axis=1)
        columns = [[k.as_py()] * len(x) for k in key] + [[d for d in rows.index], lab.astype("int32").tolist(), chance.tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return cut.select(*keys, "indicator_id", "date", "value").groupBy(*keys).applyInArrow(states, schema)


def window_states(metrics: DataFrame, features: list[str], k: int = 3, method: str = "ward") -> DataFrame:
    """(window_id, features) -> state a window: z-scored, ward or k-means on the driver (one row a window), labels by first window."""
    rows = metrics.select("window_id", *features).orderBy("window_id").toPandas()
    x = rows[features].to_numpy(float)
    x = (x - np.nanmean(x, axis=0)) / (np.nanstd(x, axis=0) + 1e-10)
    x = np.nan_to_num(x)
    k = min(k, len(x))
    lab = cohort.cut(cohort.linkage(cohort.distances(x), "ward"), len(x), k=k) if method == "ward" else cohort.kmeans(x, k)[0]
    rows["state"] = lab.astype("int32")
    return metrics.sparkSession.createDataFrame(rows[["window_id", "state"]])


def cluster_changes(assigned: DataFrame, summary: DataFrame, cluster_step: int = 2, corr_step: float = 0.15) -> DataFrame:
    """Windows where the number of clusters or the mean correlation jumps: (window_id, k, mean_corr, change)."""
    from pyspark.sql import Window

    k = assigned.groupBy("window_id").agg(F.max("k").alias("k"))
    line = Window.orderBy("window_id")
    rows = k.join(summary.select("window_id", F.col("mean_abs_corr").alias("mean_corr")), "window_id")
    rows = rows.withColumn("dk", F.col("k") - F.lag("k").over(line)).withColumn("dr", F.col("mean_corr") - F.lag("mean_corr").over(line))
    return rows.withColumn("change", F.coalesce((F.abs("dk") >= cluster_step) | (F.abs("dr") > corr_step), F.lit(False)))


def evolution(assigned: DataFrame) -> DataFrame:
    """Consecutive windows: members that moved, and split, merge, reconfigure or stable."""
    from pyspark.sql import Window

    line = Window.partitionBy("indicator_id").orderBy("window_id")
    rows = assigned.withColumn("before", F.lag("cluster").over(line)).where(F.col("before").isNotNull())
    g = rows.groupBy("window_id").agg(F.count_distinct("before").alias("k_before"), F.count_distinct("cluster").alias("k_after"), F.count_distinct("before", "cluster").alias("links"), F.count("*").alias("n"))
    kind = F.when((F.col("links") == F.col("k_before")) & (F.col("links") == F.col("k_after")), "stable").when(F.col("links") == F.col("k_after"), "split").when(F.col("links") == F.col("k_before"), "merge").otherwise("reconfigure")
    return g.withColumn("kind", kind)
