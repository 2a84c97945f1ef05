"""Streaming forms of the incremental trackers.

The batch operators are the specification: fed the same rows in date order, the
trackers end with the same summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a tracker keeps of an entity, whatever the stream's length.
STATE = "n long, n_outside long, crossings long, churn double, last double, before double, was_outside boolean, episode int, episodes long, longest long, total_days long, peak double, late long, last_ts timestamp"
SUMMARY = "entity string, ts timestamp, n long, excursion_rate double, crossings long, churn double, episodes long, longest long, peak double, velocity double, state string, late long"


def track(series: DataFrame, radius: float, noise: float = 0.05) -> DataFrame:
    """(entity, ts, distance) stream -> a summary an entity and batch: excursions, crossings, churn, velocity, state.

    Rows older than the last one seen are counted as late and left out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [0, 0, 0, 0.0, None, None, False, 0, 0, 0, 0, 0.0, 0, None]
        n, n_out, crossings, churn, last, before, outside, episode, episodes, longest, days, peak, late, last_ts = s
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, d in zip(rows["ts"], rows["distance"]):
            if last_ts is not None and ts <= pd.Timestamp(last_ts):
                late += 1
                continue
            now = bool(d > radius)
            if last is not None:
                crossings += now != outside
                churn += abs(d - last)
            if now:
                episode = episode + 1 if outside else 1
                episodes += not outside
                days += 1
                longest, peak = max(longest, episode), max(peak, d)
                n_out += 1
            n, before, last, outside, last_ts = n + 1, last, float(d), now, ts
        state.update((n, n_out, crossings, churn, last, before, outside, int(episode), episodes, longest, days, float(peak), late, last_ts))
        v = None if before is None else last - before
        kind = "inside" if last <= radius else "stalling" if v is None or abs(v) <= noise else "reverting" if v < 0 else "escalating"
        yield pd.DataFrame([(key[0], last_ts, n, n_out / n, crossings, churn / (n - 1) if n > 1 else None, episodes, longest, peak, v, kind, late)], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return series.groupBy("entity").applyInPandasWithState(update, SUMMARY, STATE, "update", GroupStateTimeout.NoTimeout)


def recent(series: DataFrame, keep: int = 100, value: str = "value") -> DataFrame:
    """A bounded memory of the last ``keep`` values of each entity: mean, deviation, z of the last one."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts")
        held = (held + [float(x) for x in rows[value] if x == x])[-keep:]
        state.update((held,))
        s = pd.Series(held, dtype=float)
        sd = s.std(ddof=0) if len(s) else None
        yield pd.DataFrame([(key[0], len(s), s.mean() if len(s) else None, sd, (s.iloc[-1] - s.mean()) / sd if sd else None)], columns=["entity", "n", "mean", "std", "z_last"])

    return series.groupBy("entity").applyInPandasWithState(update, "entity string, n long, mean double, std double, z_last double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def sliding_stats(events: DataFrame, key: str, ts: str, value: str, size: str, slide: str, delay: str) -> DataFrame:
    """Sliding windows under a watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("high")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "total", "mean", "high")


def sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Session windows under a watermark."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
