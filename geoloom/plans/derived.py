"""The derived phase as one plan: every series, pair and cohort descriptor of every window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.operators import descriptors, grouped, joins, pairs
from geoloom.operators.panel import finite_only, log_returns, min_observations
from geoloom.operators.windows import by_rows


def native_series(panel: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Native descriptors of each series in tall form; all of them start from one shuffle on the keys."""
    panel = panel.repartition(*keys)
    parts = [descriptors.basic_stats(panel, keys), descriptors.trend(panel, keys), descriptors.volatility(panel, keys), descriptors.half_life(panel, keys), descriptors.variance_ratio(panel, keys=keys), descriptors.signature_diagnostics(panel, keys)]
    out = None
    for p in parts:
        t = descriptors.tall(p, keys)
        out = t if out is None else out.unionByName(t)
    return out.select(*keys, F.lit("native").alias("kernel"), "dimension", "value")


def derive(panel: DataFrame, window: int = 252, step: int = 21, kernels: list[str] | None = None, pair_threshold: float = 0.6, pair_kernels: list[str] | None = None, most_pairs: int | None = None, run: str = "run") -> dict[str, DataFrame]:
    """series, correlations, pairs, cohorts: frames for all windows, lazily.

    Cheap correlations of all pairs come first; only strong pairs reach the
    costly kernels.
    """
    clean = min_observations(finite_only(panel), window)
    keys = ("indicator_id", "window_id")
    cut = by_rows(clean, window, step).select("window_id", "indicator_id", "date", "value").repartition(*keys)
    series = native_series(cut, keys).unionByName(grouped.series_descriptors(cut, kernels, keys, run))
    returns = by_rows(log_returns(clean).where(F.col("value").isNotNull()), window, step).select("window_id", "indicator_id", "date", "value")
    corr = pairs.correlation_pairs(returns, ("window_id",), 30)
    strong = pairs.strong_pairs(corr, pair_threshold, most_pairs, ("window_id",))
    chosen = joins.pairs_on_date(returns, ("window_id",)).join(strong.select("window_id", "id_1", "id_2"), ["window_id", "id_1", "id_2"], "left_semi")
    return {
        "series": series, "correlations": corr, "pairs": grouped.pair_descriptors(chosen, pair_kernels or ["granger", "dtw"], ("window_id",), run), "cohorts": grouped.eigen_structure(corr), "clusters": grouped.clusters(corr),
    }


def run_library(panel: DataFrame) -> dict[str, dict]:
    """The small packaged report: correlation, first-factor share and Hurst of a panel."""
    corr = pairs.correlation_pairs(panel).persist()  # levels, as the packaged library has it
    summary = pairs.correlation_summary(corr).first()
    eigen = {r["dimension"]: r["value"] for r in grouped.eigen_structure(corr.withColumn("window_id", F.lit(0))).where("indicator_id IS NULL").collect()}
    hurst = {r["indicator_id"]: r["hurst"] for r in descriptors.hurst_rs(panel).collect()}
    corr.unpersist()
    return {
        "correlation": {"mean_abs_corr": summary["mean_abs_corr"], "strongest": f"{summary['strong_1']}-{summary['strong_2']}", "strongest_corr": summary["strong_corr"], "weakest": f"{summary['weak_1']}-{summary['weak_2']}", "weakest_corr": summary["weak_corr"]},
        "pca": {"gfm": eigen.get("gfm"), "effective_dimension": eigen.get("dim_90"), "variance_explained_1": eigen.get("variance_explained_1")}, "hurst": hurst,
    }
