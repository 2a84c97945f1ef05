"""Panel operators: clean, align, normalise, discretise, views, resampling, profiles.

A panel is (indicator_id, date, value).  Everything is partitioned by
indicator_id, so one shuffle serves a chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import EPS, clip, div, ln_pos



def by():
    return Window.partitionBy("indicator_id")


def line():
    return by().orderBy("date")


def select_panel(panel: DataFrame, ids=None, start=None, end=None, prefix=None, suffix=None, source=None) -> DataFrame:
    """Filters that reach the scan: ids, inclusive date range, id prefix/suffix, source."""
    if ids is not None:
        panel = panel.where(F.col("indicator_id").isin(list(ids)))
    if start is not None:
        panel = panel.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col("date") <= F.lit(end).cast("date"))
    if prefix is not None:
        panel = panel.where(F.col("indicator_id").startswith(prefix))
    if suffix is not None:
        panel = panel.where(F.col("indicator_id").endswith(suffix))
    if source is not None:
        panel = panel.where(F.col("source") == source)
    return panel


def indicators(panel: DataFrame) -> DataFrame:
    return panel.select("indicator_id").distinct()


def finite_only(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def min_observations(panel: DataFrame, n: int) -> DataFrame:
    """Indicators with n values at least."""
    enough = panel.groupBy("indicator_id").agg(F.count("value").alias("n_obs")).where(F.col("n_obs") >= n).select("indicator_id")
    return panel.join(enough, "indicator_id", "left_semi")


def keep_latest(panel: DataFrame, order: Column | None = None) -> DataFrame:
    """One row a date: the last by ``order`` (default: the largest value, nulls first)."""
    w = Window.partitionBy("indicator_id", "date").orderBy((order if order is not None else F.col("value")).desc_nulls_last())
    return panel.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clean_series(panel: DataFrame, max_gap_fill: int = 5, order: Column | None = None) -> DataFrame:
    """Sort, keep the last row of a date, fill gaps of up to ``max_gap_fill`` rows forward, drop what stays null."""
    value = F.when(~F.isnan("value"), F.col("value"))
    filled = F.last(value, ignorenulls=True).over(line().rowsBetween(-max_gap_fill, 0))
    return keep_latest(panel, order).withColumn("value", filled).where(F.col("value").isNotNull())


def cleaning_report(raw: DataFrame, max_gap_fill: int = 5) -> DataFrame:
    """Rows before and after, duplicates, nulls filled, method, per indicator."""
    before = raw.groupBy("indicator_id").agg(F.count("*").alias("rows_before"), F.count("value").alias("values_before"), F.count_distinct("date").alias("dates"))
    after = clean_series(raw, max_gap_fill).groupBy("indicator_id").agg(F.count("*").alias("rows_after"))
    kept = keep_latest(raw).groupBy("indicator_id").agg(F.count("value").alias("kept_values"))
    joined = before.join(after, "indicator_id", "left").join(kept, "indicator_id", "left")
    return joined.select(
        "indicator_id", "rows_before", F.coalesce("rows_after", F.lit(0)).alias("rows_after"), (F.col("rows_before") - F.col("dates")).alias("duplicates"),
        (F.coalesce("rows_after", F.lit(0)) - F.col("kept_values")).alias("nulls_filled"),
        F.when(F.coalesce("rows_after", F.lit(0)) > F.col("kept_values"), f"ffill_limit_{max_gap_fill}").otherwise("none").alias("cleaning_method"),
    )


def calendar(panel: DataFrame, business: bool = False) -> DataFrame:
    """Every day from each indicator's first to its last date."""
    days = panel.groupBy("indicator_id").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return days.where(F.dayofweek("date").between(2, 6)) if business else days


def align_to_daily(panel: DataFrame) -> DataFrame:
    """Left join to the calendar, forward fill without limit."""
    spans = panel.groupBy("indicator_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = spans.select("indicator_id", F.explode(F.sequence("lo", "hi")).alias("date"))
    joined = days.join(panel.select("indicator_id", "date", "value"), ["indicator_id", "date"], "left")
    filled = F.last("value", ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("value", filled).where(F.col("value").isNotNull())


def fill_both_ways(panel: DataFrame) -> DataFrame:
    """Forward, then backward fill."""
    forward = F.last("value", ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first("value", ignorenulls=True).over(line().rowsBetween(0, Window.unboundedFollowing))
    return panel.withColumn("value", F.coalesce(forward, backward))


def validate_panel(panel: DataFrame, min_rows: int = 10) -> DataFrame:
    """One row an indicator: rows, nulls, duplicate dates, non-finite values, range, and whether it passes."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    out = panel.groupBy("indicator_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("n_bad"),
        (F.count("date") - F.count_distinct("date")).alias("n_duplicates"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return out.withColumn("ok", (F.col("n_rows") >= min_rows) & (F.col("n_bad") == 0) & (F.col("n_duplicates") == 0) & (F.col("n_null") < F.col("n_rows")))


# ---- normalisation: each returns the panel with value replaced


def zscore(panel: DataFrame, ddof: int = 1) -> DataFrame:
    """ddof 1: NULL on constants.  ddof 0: a small constant is added to the deviation."""
    centred = F.col("value") - F.avg("value").over(by())
    scale = F.nullif(F.stddev_samp("value").over(by()), F.lit(0.0)) if ddof else F.stddev_pop("value").over(by()) + F.lit(EPS)
    return panel.withColumn("value", div(centred, scale))


def minmax(panel: DataFrame) -> DataFrame:
    lo, hi = F.min("value").over(by()), F.max("value").over(by())
    return panel.withColumn("value", div(F.col("value") - lo, hi - lo))


def pct_change(panel: DataFrame) -> DataFrame:
    before = F.lag("value").over(line())
    return panel.withColumn("value", div(F.col("value") - before, before))


simple_returns = pct_change


def abs_returns(panel: DataFrame, limit: float | None = None) -> DataFrame:
    """Change over the absolute previous value; clipped to +-limit where given."""
    before = F.lag("value").over(line())
    r = (F.col("value") - before) / (F.abs(before) + F.lit(EPS))
    return panel.withColumn("value", r if limit is None else clip(r, -limit, limit))


def log_returns(panel: DataFrame, floor: float | None = None, drop_above: float | None = None) -> DataFrame:
    """ln(v / previous); non-positive values give NULL unless floored; |r| >= drop_above become NULL."""
    v = F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(floor))) if floor is not None else F.col("value")
    r = ln_pos(v) - ln_pos(F.lag(v).over(line()))
    if drop_above is not None:
        r = F.when(F.abs(r) < drop_above, r)
    return panel.withColumn("value", r)


def first_difference(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.col("value") - F.lag("value").over(line()))


def average_rank(value: Column, by) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def percent_rank_avg(panel: DataFrame, plus_one: bool = False) -> DataFrame:
    """Average rank over n (or n + 1)."""
    n = F.count("value").over(by()) + (1 if plus_one else 0)
    return panel.withColumn("value", average_rank(F.col("value"), ["indicator_id"]) / n)


NORMALISERS = {"zscore": zscore, "zscore_pop": lambda p: zscore(p, 0), "minmax": minmax, "returns": pct_change, "log_returns": log_returns, "rank": percent_rank_avg, "diff": first_difference, "none": lambda p: p}


def normalise(panel: DataFrame, method: str) -> DataFrame:
    return NORMALISERS[method](panel)


def discretise(panel: DataFrame, n_bins: int = 8, method: str = "quantile") -> DataFrame:
    """Adds bin (from 0): right-closed quantile bins with equal edges dropped, or equal width."""
    if method == "equal":
        lo, hi = F.min("value").over(by()), F.max("value").over(by())
        share = div(F.col("value") - lo, hi - lo)
        return panel.withColumn("bin", F.when(share.isNull(), 0).otherwise(F.greatest(F.ceil(share * n_bins) - 1, F.lit(0))).cast("int"))
    edges = panel.groupBy("indicator_id").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)]))).alias("inner"), F.min("value").alias("lo"))
    joined = panel.join(edges, "indicator_id")
    inner = F.filter("inner", lambda e: e > F.col("lo"))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("value")))).drop("inner", "lo")


def view(panel: DataFrame, kind: str, window: int = 21, min_periods: int = 10) -> DataFrame:
    """LEVEL, RETURNS, VOLATILITY, DEVIATION (= ANOMALY), INCIDENCE (= difference)."""
    kind = kind.upper()
    frame = line().rowsBetween(-(window - 1), 0)
    if kind == "LEVEL":
        return panel
    if kind == "RETURNS":
        return abs_returns(panel, 10.0)
    if kind == "INCIDENCE":
        return first_difference(panel)
    if kind == "VOLATILITY":
        r = abs_returns(panel, 10.0)
        sd = F.stddev_samp("value").over(frame)
        return r.withColumn("value", F.when(F.count("value").over(frame) >= min_periods, sd))
    if kind in ("DEVIATION", "ANOMALY"):
        mean, sd, n = F.avg("value").over(frame), F.stddev_samp("value").over(frame), F.count("value").over(frame)
        return panel.withColumn("value", F.when(n >= min_periods, div(F.col("value") - mean, F.nullif(sd, F.lit(0.0)))))
    raise ValueError(f"no view {kind}")


def to_wide(panel: DataFrame, ids: list[str]) -> DataFrame:
    """One column an indicator; ids are given, so no extra job finds them."""
    return panel.groupBy("date").pivot("indicator_id", ids).agg(F.first("value"))


def to_long(wide: DataFrame, date_col: str = "date") -> DataFrame:
    values = [c for c in wide.columns if c != date_col]
    return wide.select(date_col, *[F.col(c).cast("double").alias(c) for c in values]).unpivot([date_col], values, "indicator_id", "value").select("indicator_id", F.col(date_col).alias("date"), "value")


#: How a kind of series is brought to a coarser grid.  It is never brought to a finer one.
RESAMPLING = {"price": "last", "index": "last", "yield": "mean", "rate": "mean", "spread": "mean", "flow": "sum", "volume": "sum", "count": "sum", "level": "last", "volatility": "mean", "max": "max", "min": "min"}
GRIDS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def resample(panel: DataFrame, grid: str, rule: str) -> DataFrame:
    """Last, mean, sum, max or min of each period; ``rule`` is one of these or a kind of series."""
    rule = RESAMPLING.get(rule, rule)
    agg = {"last": F.max_by("value", "date"), "mean": F.avg("value"), "sum": F.sum("value"), "max": F.max("value"), "min": F.min("value")}[rule]
    return panel.groupBy("indicator_id", F.to_date(F.date_trunc(GRIDS[grid], "date")).alias("date")).agg(agg.alias("value"))


def frequency_of(interval: Column) -> Column:
    return F.when(interval <= 1.5, "daily").when(interval <= 8, "weekly").when(interval <= 35, "monthly").when(interval <= 100, "quarterly").otherwise("irregular")


def temporal_profile(panel: DataFrame) -> DataFrame:
    """Observations, span, mean and median gap, frequency."""
    gaps = panel.withColumn("gap", F.datediff("date", F.lag("date").over(line())))
    out = gaps.groupBy("indicator_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_obs"), F.datediff(F.max("date"), F.min("date")).alias("span_days"), F.median("gap").alias("median_interval"),
        F.stddev_pop("gap").alias("gap_sd"),
    )
    mean = div(F.col("span_days").cast("double"), (F.col("n_obs") - 1).cast("double"))
    out = out.withColumn("mean_interval", mean).withColumn("frequency", frequency_of(mean))
    irregular = F.coalesce(div(F.col("gap_sd"), F.col("median_interval")) > 0.01, F.lit(False))
    return out.select("indicator_id", "first_date", "last_date", "n_obs", "span_days", "mean_interval", "median_interval", "frequency", irregular.alias("is_irregular"))


def daily_events(events: DataFrame, time: str = "time", mag: str = "mag", depth: str = "depth", key=()) -> DataFrame:
    """COUNT, ENERGY (log10 of the summed 10^(1.5 m + 4.8)), MAX, MEAN magnitude and MEAN depth on the full calendar; COUNT is zero-filled."""
    keys = list(key)
    day = events.withColumn("date", F.to_date(time))
    agg = day.groupBy(*keys, "date").agg(
        F.count("*").alias("n"), F.log10(F.sum(F.pow(F.lit(10.0), F.col(mag) * 1.5 + 4.8))).alias("energy"), F.max(mag).alias("max_mag"), F.avg(mag).alias("mean_mag"), F.avg(depth).alias("mean_depth")
    )
    spans = agg.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi")) if keys else agg.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = spans.select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(agg, [*keys, "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def monthly_moment(events: DataFrame, time: str = "time", mag: str = "mag") -> DataFrame:
    """Monthly count and seismic moment, 10^(1.5 m + 9.1)."""
    return events.groupBy(F.to_date(F.date_trunc("month", time)).alias("date")).agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(10.0), F.col(mag) * 1.5 + 9.1)).alias("moment"))


def epiweek_to_date(epiweek: Column) -> Column:
    """Sunday of an MMWR week yyyyww: week 1 is the one with at least four days in the year."""
    year, week = F.floor(epiweek / 100).cast("int"), (epiweek % 100).cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.dayofweek(jan4) - 1), (week - 1) * 7)


def date_to_epiweek(date: Column) -> Column:
    sunday = F.date_sub(date, F.dayofweek(date) - 1)
    year = F.year(F.date_add(sunday, 3))
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    first = F.date_sub(jan4, F.dayofweek(jan4) - 1)
    return (year * 100 + F.floor(F.datediff(sunday, first) / 7) + 1).cast("int")
