"""Aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import safe_corr


def summary(df: DataFrame, keys: list[str], value: str = "value", rollup: bool = False) -> DataFrame:
    g = df.rollup(*keys) if rollup else df.groupBy(*keys)
    return g.agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def conditional_pivot(df: DataFrame, keys: list[str], column: str, values: list, of: Column) -> DataFrame:
    """MAX(CASE WHEN column = v THEN of END) for each v."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, of)).alias(str(v)) for v in values])


def status_counts(df: DataFrame, keys: list[str], column: str, values: list) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"n_{v}") for v in values], F.count("*").alias("n"))


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(safe_corr(F.col(x), F.col(y)).alias("corr"), F.sum((F.col(x).isNotNull() & F.col(y).isNotNull()).cast("long")).alias("n"))


def percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact, linear interpolation."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"p{int(round(p * 100))}") for p in points])


def percentiles_approx(df: DataFrame, keys: list[str], value: str, points: list[float], accuracy: int = 10_000) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile_approx(value, points, accuracy).alias("points"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value; the smallest of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def dedupe(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row by ``order`` of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def births_deaths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members new in or gone from the second of two sets."""
    return after.exceptAll(before).withColumn("change", F.lit("birth")).unionByName(before.exceptAll(after).withColumn("change", F.lit("death")))


def rank_in_windows(scores: DataFrame) -> DataFrame:
    """(lens, window_id, indicator_id, score) -> rank 1.. by score, descending; ties by id."""
    w = Window.partitionBy("lens", "window_id").orderBy(F.desc("score"), "indicator_id")
    return scores.withColumn("rank", F.row_number().over(w))


def consensus(ranked: DataFrame) -> DataFrame:
    """Mean rank over lenses, and the consensus rank in each window."""
    mean = ranked.groupBy("window_id", "indicator_id").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_lenses"))
    return mean.withColumn("consensus_rank", F.row_number().over(Window.partitionBy("window_id").orderBy("mean_rank", "indicator_id")))
