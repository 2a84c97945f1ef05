"""Window assignment: every rule turns windows into an equi-key by exploding, never a range join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

#: Days (window, step) by domain and rows (window, step) by resolution.  Fixed values.
DOMAIN_DAYS = {"economic": (252, 21), "climate": (180, 30), "epidemiology": (365, 30), "seismology": (90, 7)}


@dataclass(frozen=True)
class Resolution:
    window: int
    step: int


RESOLUTIONS = {"weekly": Resolution(63, 5), "monthly": Resolution(252, 21), "quarterly": Resolution(504, 63), "fine": Resolution(126, 5)}


def by_rows(panel: DataFrame, window: int = 252, step: int = 21) -> DataFrame:
    """Row-count windows: number k holds rows k*step .. k*step+window-1; only full ones.  Adds window_id, window_start, window_end."""
    counted = panel.withColumn("rn", F.row_number().over(Window.partitionBy("indicator_id").orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("indicator_id")))
    first = F.greatest(F.ceil((F.col("rn") - window + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col("rn") / F.lit(step)), F.floor((F.col("n") - window) / F.lit(step)))
    hit = counted.where((F.col("n") >= window) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    w = Window.partitionBy("indicator_id", "window_id")
    return hit.withColumn("window_start", F.min("date").over(w)).withColumn("window_end", F.max("date").over(w)).drop("rn", "n")


def scan_windows(panel: DataFrame, years: float, step: int = 63, min_share: float = 0.8, min_windows: int = 10, year_rows: int = 252) -> DataFrame:
    """Row-count windows of ``years``; those with enough values, for indicators with enough windows."""
    size = int(years * year_rows)
    cut = by_rows(panel, size, step)
    ok = cut.groupBy("indicator_id", "window_id").agg(F.count("value").alias("n_obs")).where(F.col("n_obs") >= min_share * size)
    enough = ok.groupBy("indicator_id").agg(F.count("*").alias("n_windows")).where(F.col("n_windows") >= min_windows)
    return cut.join(ok.join(enough, "indicator_id").select("indicator_id", "window_id"), ["indicator_id", "window_id"], "left_semi")


def common_range(panel: DataFrame) -> DataFrame:
    """(start, end): the latest first date and the earliest last date; no row where they don't overlap."""
    spans = panel.groupBy("indicator_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return spans.agg(F.max("lo").alias("start"), F.min("hi").alias("end")).where("start <= end")


def by_days(panel: DataFrame, window_days: int = 252, step_days: int = 21, start=None) -> DataFrame:
    """Calendar windows, inclusive at both ends: ends lie at start + window + k * step; each row goes to the ends within ``window_days`` after it.

    ``start`` defaults to the indicators' common start; ends stop at the common end.
    """
    span = F.broadcast(common_range(panel))  # one row
    joined = panel.crossJoin(span) if start is None else panel.crossJoin(span).withColumn("start", F.lit(start).cast("date"))
    joined = joined.where((F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
    base = F.date_add("start", window_days)
    first = F.greatest(F.ceil(F.datediff("date", base) / F.lit(step_days)), F.lit(0))
    last = F.least(F.floor((F.datediff("date", base) + window_days) / F.lit(step_days)), F.floor(F.datediff("end", base) / F.lit(step_days)))
    hit = joined.where(first <= last).withColumn("window_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    end = F.date_add(F.date_add("start", window_days), F.col("window_id") * step_days)
    return hit.withColumn("window_end", end).withColumn("window_start", F.date_sub(F.col("window_end"), window_days)).drop("start", "end")


def by_native_sampling(panel: DataFrame, profile: DataFrame, min_obs: int = 30, slack: float = 1.2) -> DataFrame:
    """One window an indicator: interval * min_obs * slack days up to its last date."""
    days = F.ceil(F.col("mean_interval") * F.lit(min_obs * slack)).cast("int")
    limits = profile.select("indicator_id", F.col("last_date").alias("window_end"), F.date_sub("last_date", days).alias("window_start"))
    return panel.join(limits, "indicator_id").where((F.col("date") >= F.col("window_start")) & (F.col("date") <= F.col("window_end")))


def by_schedule(panel: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """A fixed list of inclusive windows, as a literal array: rows are exploded to those that hold them."""
    array = F.array(*[F.struct(F.lit(a).cast("date").alias("window_start"), F.lit(b).cast("date").alias("window_end")) for a, b in windows])
    mine = F.filter(array, lambda w: (w["window_start"] <= F.col("date")) & (F.col("date") <= w["window_end"]))
    return panel.withColumn("__w", F.explode(mine)).select("*", "__w.*").drop("__w")


def calendar_years(first: int = 2018, last: int = 2024) -> list[tuple[str, str]]:
    return [(f"{y}-01-01", f"{y}-12-31") for y in range(first, last + 1)]


def by_resolution(panel: DataFrame, name: str) -> DataFrame:
    r = RESOLUTIONS[name]
    return by_rows(panel, r.window, r.step)
