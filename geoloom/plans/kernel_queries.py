"""Queries on kernels: no SQL form, checked by closed forms in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import grouped, joins, pairs, panel as P, windows
from geoloom.plans.native_queries import query, rounded
from geoloom.plans.panels import events_hourly, nation_monthly, orders_daily, ship_daily


@query()
def series_kernels(spark, sf_dir):
    """All series kernels over each order priority's daily values, in one grouped pass."""
    return rounded(grouped.series_descriptors(orders_daily(spark, sf_dir), [k for k in grouped.SERIES if k not in ("rqa", "lyapunov")]))


@query()
def recurrence_kernels(spark, sf_dir):
    return rounded(grouped.series_descriptors(events_hourly(spark, sf_dir), ["rqa", "lyapunov"]))


@query()
def pair_kernels(spark, sf_dir):
    """Pair kernels on the pairs of daily log returns."""
    return rounded(grouped.pair_descriptors(joins.pairs_on_date(P.log_returns(orders_daily(spark, sf_dir))), ["granger", "dtw", "coherence", "mutual_information", "transfer_entropy"]))


@query()
def cointegration_kernels(spark, sf_dir):
    return rounded(grouped.pair_descriptors(joins.pairs_on_date(ship_daily(spark, sf_dir)), ["cointegration"]))


@query()
def hidden_states(spark, sf_dir):
    return rounded(grouped.hidden_states(P.abs_returns(ship_daily(spark, sf_dir)).where(F.col("value").isNotNull())))


def _windowed_corr(spark, sf_dir):
    cut = windows.by_rows(P.log_returns(nation_monthly(spark, sf_dir)).where(F.col("value").isNotNull()), 36, 12)
    return pairs.correlation_pairs(cut.select("window_id", "indicator_id", "date", "value"), ("window_id",))


@query()
def eigen_structure(spark, sf_dir):
    return rounded(grouped.eigen_structure(_windowed_corr(spark, sf_dir)))


@query()
def cluster_ensemble(spark, sf_dir):
    return rounded(grouped.clusters(_windowed_corr(spark, sf_dir)))


@query()
def decontamination(spark, sf_dir):
    return rounded(grouped.decontamination(_windowed_corr(spark, sf_dir)))


@query()
def mahalanobis(spark, sf_dir):
    return rounded(grouped.mahalanobis(_windowed_corr(spark, sf_dir)))


@query()
def panel_modes(spark, sf_dir):
    cut = windows.by_rows(events_hourly(spark, sf_dir), 200, 100).select("window_id", "indicator_id", "date", "value")
    return rounded(grouped.panel_modes(cut))


@query()
def panel_states(spark, sf_dir):
    cut = windows.by_rows(events_hourly(spark, sf_dir), 200, 100).select("window_id", "indicator_id", "date", "value")
    return rounded(grouped.panel_states(cut))


@query()
def kmeans_clusters(spark, sf_dir):
    return rounded(grouped.clusters(_windowed_corr(spark, sf_dir), "kmeans"))


@query()
def ward_clusters(spark, sf_dir):
    return rounded(grouped.clusters(_windowed_corr(spark, sf_dir), "ward", remove_pc1=True))


@query()
def wavelet_energies(spark, sf_dir):
    return rounded(grouped.wavelet_table(orders_daily(spark, sf_dir)), 4)


@query()
def stationarity_forcing(spark, sf_dir):
    from geoloom.operators import policy

    p = orders_daily(spark, sf_dir)
    raw = P.abs_returns(p, 10.0).select("indicator_id", "date", F.col("value").alias("cleaned"))
    both = p.select("indicator_id", "date", F.col("value").alias("raw")).join(raw, ["indicator_id", "date"]).where(F.col("cleaned").isNotNull())
    return rounded(policy.stationarity_forcing(both))


@query()
def cohort_views(spark, sf_dir):
    return rounded(grouped.cohort_views(_windowed_corr(spark, sf_dir), threshold=0.3))


@query()
def attribution_intervals(spark, sf_dir):
    from geoloom.operators import dynamics

    p = events_hourly(spark, sf_dir)
    total = p.groupBy("date").agg(F.sum("value").alias("v"))
    bar = total.agg((F.avg("v") + F.stddev_pop("v")).alias("bar"))  # one row
    flag = total.crossJoin(F.broadcast(bar)).select("date", (F.col("v") > F.col("bar")).alias("flag"))
    return rounded(dynamics.attribution_intervals(flag, p))
