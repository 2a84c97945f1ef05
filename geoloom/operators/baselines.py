"""Traditional methods and the evaluation against events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.mathx import div
from geoloom.operators.joins import first_before
from geoloom.operators.panel import line


#: Named threshold sets.
THRESHOLDS = {"volatility_index": [15.0, 25.0, 35.0], "yield_curve": [0.0, 0.5, 1.5]}


def threshold_states(panel: DataFrame, thresholds: list[float]) -> DataFrame:
    """state = number of thresholds at or below the value."""
    state = F.lit(0)
    for t in thresholds:
        state = state + (F.col("value") >= t).cast("int")
    return panel.withColumn("state", state)


def quantile_states(panel: DataFrame, points: tuple[float, ...] = (0.33, 0.67)) -> DataFrame:
    edges = panel.groupBy("indicator_id").agg(F.percentile("value", F.array(*[F.lit(p) for p in points])).alias("edges"))
    return panel.join(edges, "indicator_id").withColumn("state", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges")


def volatility_states(panel: DataFrame, window: int = 21, points: tuple[float, ...] = (0.33, 0.67)) -> DataFrame:
    """States of rolling volatility by quantile: the fallback for Markov switching."""
    w = line().rowsBetween(-(window - 1), 0)
    before = F.lag("value").over(line())
    r = panel.withColumn("r", div(F.col("value") - before, before))
    vol = r.withColumn("vol", F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w))).where(F.col("vol").isNotNull())
    return quantile_states(vol.select("indicator_id", "date", F.col("vol").alias("value")), points)


def transition_matrix(states: DataFrame) -> DataFrame:
    """(indicator_id, state, next_state, n, p)."""
    t = states.withColumn("next_state", F.lead("state").over(line())).where(F.col("next_state").isNotNull()).groupBy("indicator_id", "state", "next_state").agg(F.count("*").alias("n"))
    return t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("indicator_id", "state")))


def average_crosses(panel: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Rows where the fast average crosses the slow one: golden or death."""
    f, s = line().rowsBetween(-(fast - 1), 0), line().rowsBetween(-(slow - 1), 0)
    rows = panel.withColumn("fast", F.when(F.count("value").over(f) == fast, F.avg("value").over(f))).withColumn("slow", F.when(F.count("value").over(s) == slow, F.avg("value").over(s))).where(F.col("slow").isNotNull())
    rows = rows.withColumn("above", (F.col("fast") > F.col("slow")).cast("int"))
    rows = rows.withColumn("turn", F.col("above") - F.lag("above").over(line()))
    return rows.where("turn <> 0").withColumn("cross", F.when(F.col("turn") > 0, "golden").otherwise("death")).select("indicator_id", "date", "fast", "slow", "cross")


def trend_strength(panel: DataFrame, window: int = 20) -> DataFrame:
    """(value - average) over deviation of full frames."""
    w = line().rowsBetween(-(window - 1), 0)
    z = div(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)))
    return panel.withColumn("strength", F.when(F.count("value").over(w) == window, z))


def lead_times(events: DataFrame, signals_a: DataFrame, signals_b: DataFrame, lookback: int = 60) -> DataFrame:
    """Lead of two methods' first signals before each event, and which was earlier."""
    a = first_before(events, signals_a, lookback).select("event_id", "date", F.col("lead_days").alias("lead_a"))
    b = first_before(events, signals_b, lookback).select("event_id", F.col("lead_days").alias("lead_b"))
    better = F.when(F.col("lead_a").isNull() & F.col("lead_b").isNull(), "none").when(F.col("lead_b").isNull() | (F.col("lead_a") > F.col("lead_b")), "a").when(F.col("lead_a").isNull() | (F.col("lead_b") > F.col("lead_a")), "b").otherwise("tie")
    return a.join(b, "event_id").withColumn("earlier", better)


def false_positives(signals: DataFrame, events: DataFrame, tolerance: int = 5) -> DataFrame:
    """Signals without an event within +-tolerance days, and their share.  Events are spread over the days they excuse: an equi-join."""
    near = events.select(F.explode(F.sequence(F.date_sub("date", tolerance), F.date_add("date", tolerance))).alias("date")).distinct().withColumn("near", F.lit(1))
    rows = signals.select("date").distinct().join(near, "date", "left")
    return rows.agg(F.count("*").alias("n_signals"), F.sum(F.col("near").isNull().cast("long")).alias("n_false"), F.avg(F.col("near").isNull().cast("double")).alias("false_rate"))
