"""Rolling frames, streaks, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import div, safe_corr_over
from geoloom.operators.joins import pairs_on_date
from geoloom.operators.panel import line



def frame(n: int, over=None):
    return (line() if over is None else over).rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, min_periods: int, over=None, count: Column | None = None) -> Column:
    """``value`` where the frame has min_periods rows."""
    return F.when(F.count(count if count is not None else F.col("value")).over(frame(n, over)) >= min_periods, value)


def rolling(panel: DataFrame, n: int, min_periods: int | None = None) -> DataFrame:
    w = frame(n)
    m = n if min_periods is None else min_periods
    out = {"roll_mean": F.avg("value").over(w), "roll_std": F.stddev_samp("value").over(w), "roll_var": F.var_samp("value").over(w), "roll_min": F.min("value").over(w), "roll_max": F.max("value").over(w)}
    return panel.withColumns({k: full(v, n, m) for k, v in out.items()})


def rolling_beta(panel: DataFrame, reference: str, window: int = 60, min_periods: int = 30) -> DataFrame:
    """Rolling covariance over reference variance for each other indicator of a return panel."""
    ref = panel.where(F.col("indicator_id") == reference).select("date", F.col("value").alias("ref"))
    both = panel.where(F.col("indicator_id") != reference).join(ref, "date").where(F.col("value").isNotNull() & F.col("ref").isNotNull())
    w = frame(window)
    beta = div(F.covar_samp("value", "ref").over(w), F.var_samp("ref").over(w))
    return both.withColumn("beta", full(beta, window, min_periods))


def beta_summary(betas: DataFrame) -> DataFrame:
    return betas.where(F.col("beta").isNotNull()).groupBy("indicator_id").agg(F.avg("beta").alias("beta_mean"), F.stddev_pop("beta").alias("beta_std"), F.min("beta").alias("beta_min"), F.max("beta").alias("beta_max"), F.max_by("beta", "date").alias("beta_current"))


def rolling_pair_corr(panel: DataFrame, window: int = 60) -> DataFrame:
    """Correlation of each pair over full frames."""
    pair = Window.partitionBy("id_1", "id_2").orderBy("date")
    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    corr = safe_corr_over(F.col("x"), F.col("y"), frame(window, pair))
    return both.withColumn("corr", full(corr, window, window, pair, F.col("x"))).where(F.col("corr").isNotNull()).select("id_1", "id_2", "date", "corr")


def correlation_dispersion(rolled: DataFrame) -> DataFrame:
    """Average, extremes and dispersion over pairs for each date."""
    return rolled.groupBy("date").agg(F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"), F.min("corr").alias("min_corr"), F.stddev_samp("corr").alias("dispersion"), F.count("*").alias("n_pairs"))


def percentile_of_last(series: DataFrame, value: str, lookback: int = 252, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the frame that is at most its last value."""
    span = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(lookback - 1), 0)
    seen = F.collect_list(value).over(span)
    return series.withColumn("share_below", div(F.size(F.filter(seen, lambda x: x <= F.col(value))).cast("double"), F.size(seen).cast("double")))


def cumulative(panel: DataFrame) -> DataFrame:
    """Running sum, product of (1 + value), and maximum."""
    run = line().rowsBetween(Window.unboundedPreceding, 0)
    grown = F.when(F.min(F.lit(1) + F.col("value")).over(run) > 0, F.exp(F.sum(F.when(F.col("value") > -1, F.log1p("value"))).over(run)))
    return panel.withColumns({"cum_sum": F.sum("value").over(run), "cum_prod": grown, "cum_max": F.max("value").over(run)})


def islands(df: DataFrame, flag: str, keys: tuple[str, ...] = ("indicator_id",), order: str = "date") -> DataFrame:
    """Numbers the runs of equal ``flag``."""
    along = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(flag).over(along).eqNullSafe(F.col(flag)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn("run", F.sum("__change").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def streaks(df: DataFrame, flag: str, keys: tuple[str, ...] = ("indicator_id",), order: str = "date") -> DataFrame:
    """One row a run: flag, first, last, length."""
    return islands(df, flag, keys, order).groupBy(*keys, "run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def edges(df: DataFrame, flag: Column, keys: tuple[str, ...] = ("indicator_id",), order: str = "date") -> DataFrame:
    """Rows where ``flag`` rises (1) or falls (-1)."""
    along = Window.partitionBy(*keys).orderBy(order)
    now = flag.cast("int")
    return df.withColumn("__now", now).withColumn("edge", F.col("__now") - F.lag("__now").over(along)).where("edge <> 0").drop("__now")


def block_ranges(panel: DataFrame, size: int = 5) -> DataFrame:
    """Range of each full block of rows."""
    n = F.row_number().over(line()) - 1
    return panel.withColumn("block", F.floor(n / F.lit(size))).groupBy("indicator_id", "block").agg((F.max("value") - F.min("value")).alias("range"), F.count("*").alias("n")).where(F.col("n") == size)
