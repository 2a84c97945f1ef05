"""Cohort discovery by how series are observed, behavioural projection, lens and system geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.mathx import div, safe_corr
from geoloom.kernels import cohort

#: Weights of observation features.  Fixed values.
FEATURE_WEIGHTS = {"missing_rate": 1.0, "median_gap": 1.0, "max_gap": 0.5, "gap_cv": 0.5, "weekday_entropy": 0.5, "start_share": 1.0, "end_share": 1.0}


def observation_features(panel: DataFrame) -> DataFrame:
    """Missing rate on the cadence, gaps, weekday entropy, and start and end within the panel's span."""
    span = F.broadcast(panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi")))  # one row
    line = Window.partitionBy("indicator_id").orderBy("date")
    rows = panel.where(F.col("value").isNotNull()).withColumn("gap", F.datediff("date", F.lag("date").over(line)))
    g = rows.groupBy("indicator_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), div(F.stddev_pop("gap"), F.avg("gap")).alias("gap_cv"))
    wd = rows.groupBy("indicator_id", F.dayofweek("date").alias("wd")).agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("indicator_id"))).groupBy("indicator_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("weekday_entropy"))
    j = g.join(wd, "indicator_id").crossJoin(span)
    days = F.datediff("hi", "lo") + 1
    expected = F.greatest(F.datediff("last", "first") / F.greatest("median_gap", F.lit(1.0)) + 1, F.lit(1.0))
    return j.select("indicator_id", F.greatest(1 - F.col("n") / expected, F.lit(0.0)).alias("missing_rate"), F.coalesce("median_gap", F.lit(0.0)).alias("median_gap"), F.coalesce(F.col("max_gap").cast("double"), F.lit(0.0)).alias("max_gap"), F.coalesce("gap_cv", F.lit(0.0)).alias("gap_cv"), "weekday_entropy", (F.datediff("first", "lo") / days).alias("start_share"), (F.datediff("hi", "last") / days).alias("end_share"))


def cadence_adjusted_missing(missing: F.Column, interval: F.Column) -> F.Column:
    """1 - min(1, (1 - m) * dt)."""
    return 1 - F.least(F.lit(1.0), (1 - missing) * interval)


def observation_cohorts(panel: DataFrame, share: float = 0.5) -> DataFrame:
    """Ward on robustly scaled, weighted features, cut at ``share`` of the highest merge.  One row an indicator comes to the driver."""
    rows = observation_features(panel).orderBy("indicator_id").toPandas()
    names = list(FEATURE_WEIGHTS)
    x = rows[names].to_numpy(float)
    med = np.median(x, axis=0)
    iqr = np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)
    x = (x - med) / np.where(iqr > 0, iqr, 1) * np.sqrt([FEATURE_WEIGHTS[k] for k in names])
    if len(x) < 2:
        lab = np.zeros(len(x), int)
    else:
        tree = cohort.linkage(cohort.distances(x), "ward")
        lab = cohort.cut(tree, len(x), height=share * tree[:, 2].max())
    rows["cohort"] = lab.astype("int32")
    return panel.sparkSession.createDataFrame(rows[["indicator_id", "cohort"]])


def behaviour(panel: DataFrame, keys: tuple[str, ...] = ("indicator_id", "state")) -> DataFrame:
    """Eight dimensions of an indicator in a state: hurst, vol, skew, kurt, entropy, ac1, ac5, trend R2."""
    from geoloom.operators import descriptors as D

    line = Window.partitionBy(*keys).orderBy("date")
    rows = panel.withColumn("l1", F.lag("value", 1).over(line)).withColumn("l5", F.lag("value", 5).over(line)).withColumn("t", F.row_number().over(line).cast("double")).withColumn("d", F.col("value") - F.col("l1"))
    g = rows.groupBy(*keys).agg(F.stddev_pop("d").alias("vol"), F.skewness("d").alias("skew"), F.kurtosis("d").alias("kurt"), safe_corr(F.col("value"), F.col("l1")).alias("ac1"), safe_corr(F.col("value"), F.col("l5")).alias("ac5"), (safe_corr(F.col("t"), F.col("value")) ** 2).alias("trend_r2"))
    h = D.hurst_rs(panel, "diff", keys).select(*keys, "hurst")
    e = D.permutation_entropy(panel, keys).withColumnRenamed("permutation_entropy", "entropy")
    return g.join(h, list(keys), "left").join(e, list(keys), "left")


BEHAVIOUR = ("hurst", "vol", "skew", "kurt", "entropy", "ac1", "ac5", "trend_r2")


def state_centroids(projected: DataFrame) -> DataFrame:
    return projected.groupBy("state").agg(*[F.avg(c).alias(c) for c in BEHAVIOUR])


def movements(projected: DataFrame) -> DataFrame:
    """Distance of an indicator's behaviour between any two states."""
    a = projected.select("indicator_id", F.col("state").alias("state_1"), F.array(*BEHAVIOUR).alias("u"))
    b = projected.select("indicator_id", F.col("state").alias("state_2"), F.array(*BEHAVIOUR).alias("v"))
    gap = F.aggregate(F.zip_with("u", "v", lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "indicator_id").where("state_1 < state_2").select("indicator_id", "state_1", "state_2", F.sqrt(gap).alias("distance"))


def near_state(panel: DataFrame, states: DataFrame, state: int, days: int = 30) -> DataFrame:
    """Panel rows within +-days of a window end in the state: days are exploded, an equi-join."""
    hit = states.where(F.col("state") == state).select(F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("date")).distinct()
    return panel.join(hit, "date", "left_semi")


def macro_influence(profiles: DataFrame, masses: DataFrame) -> DataFrame:
    """(indicator_id, dimension, value) and (indicator_id, mass): pull m / d^2 of each indicator on the others."""
    a = profiles.select(F.col("indicator_id").alias("source"), "dimension", F.col("value").alias("x"))
    b = profiles.select(F.col("indicator_id").alias("target"), "dimension", F.col("value").alias("y"))
    d2 = a.join(b, "dimension").where("source <> target").groupBy("source", "target").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d2"))
    return d2.join(masses.select(F.col("indicator_id").alias("source"), "mass"), "source").withColumn("influence", div(F.col("mass"), F.nullif(F.col("d2"), F.lit(0.0))))


def micro_outliers(profiles: DataFrame, limit: float = 2.0) -> DataFrame:
    """Indicators whose value in a lens lies over ``limit`` deviations from its cohort's mean."""
    w = Window.partitionBy("cohort_id", "dimension")
    z = div(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)))
    return profiles.withColumn("z", z).where(F.abs("z") > limit)


def system_positions(corr: DataFrame, volatility: DataFrame) -> DataFrame:
    """Centrality, isolation and importance .4 centrality + .3 volatility rank + .3 uniqueness of each indicator in a window."""
    both = corr.select("window_id", F.col("id_1").alias("indicator_id"), F.abs("corr").alias("r")).unionByName(corr.select("window_id", F.col("id_2").alias("indicator_id"), F.abs("corr").alias("r")))
    g = both.groupBy("window_id", "indicator_id").agg(F.avg("r").alias("centrality"), (1 - F.max("r")).alias("uniqueness"))
    j = g.join(volatility.select("window_id", "indicator_id", "volatility"), ["window_id", "indicator_id"], "left")
    rank = F.percent_rank().over(Window.partitionBy("window_id").orderBy("volatility"))
    return j.withColumn("volatility_rank", rank).withColumn("importance", 0.4 * F.col("centrality") + 0.3 * F.col("volatility_rank") + 0.3 * F.col("uniqueness"))


def home_distances(points: DataFrame, coverage: float = 0.8, robust: bool = True, sample: int = 20_000) -> DataFrame:
    """Distance of each ``vector`` to the home region: centre, precision and radius go out as literals.

    ``robust``: minimum covariance determinant, fitted on at most ``sample``
    points (by hash of the vector).  Otherwise median and covariance of all
    points, from sums, and the radius that holds ``coverage`` of all of them.
    """
    from geoloom.operators.dynamics import distance_to

    if robust:
        n = points.count()
        part = points if n <= sample else points.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < (1 << 20) * sample / n)
        x = np.array([r["vector"] for r in part.select("vector").collect()], float)
        home = cohort.home_region(x, coverage)
        return distance_to(points, home["centre"].tolist(), home["precision"].tolist(), home["radius"])
    dim = points.select(F.max(F.size("vector"))).first()[0]
    x = [F.get("vector", F.lit(i)).cast("double") for i in range(dim)]
    sums = points.agg(F.count("*").alias("n"), *[F.median(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(dim) for j in range(i, dim)]).first()
    if sums["n"] < 100:
        raise ValueError("a home region needs 100 samples")
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(dim)] for i in range(dim)])
    centre, precision = [sums[f"m{i}"] for i in range(dim)], np.linalg.inv(cov + 1e-6 * np.eye(dim)).tolist()
    radius = distance_to(points, centre, precision, 0.0).agg(F.percentile("distance", coverage).alias("r")).first()["r"]
    return distance_to(points, centre, precision, radius)


def remove_first_component(panel: DataFrame, k: int = 1) -> DataFrame:
    """The panel less its first k principal components, on the original scale.

    Only the indicator x indicator correlations come to the driver; loadings go
    back as a table of one row an indicator, scores are one sum a date.
    Dates on which an indicator is missing keep NULL there.
    """
    from geoloom.operators.pairs import correlation_pairs

    w = Window.partitionBy("indicator_id")
    z = panel.withColumn("mean", F.avg("value").over(w)).withColumn("sd", F.stddev_samp("value").over(w)).withColumn("z", div(F.col("value") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))
    edges = correlation_pairs(panel).toPandas()
    ids = sorted({*edges["id_1"], *edges["id_2"]})
    at = {i: n for n, i in enumerate(ids)}
    m = np.eye(len(ids))
    for a, b, r in zip(edges["id_1"], edges["id_2"], edges["corr"].fillna(0.0)):
        m[at[a], at[b]] = m[at[b], at[a]] = r
    _, v = cohort.eigen(m)
    out = z
    for c in range(k):
        table = panel.sparkSession.createDataFrame([(i, float(v[at[i], c])) for i in ids], "indicator_id string, loading double")
        with_loading = out.join(table, "indicator_id")
        scores = with_loading.groupBy("date").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))
        out = with_loading.join(scores, "date").withColumn("z", F.col("z") - F.col("score") * F.col("loading")).drop("score", "loading")
    return out.select("indicator_id", "date", (F.col("mean") + F.col("z") * F.col("sd")).alias("value"))


def coupling(vectors: DataFrame, domain: str = "domain", vector: str = "vector") -> DataFrame:
    """Cosine of the centroids of any two domains."""
    x = vectors.select(domain, F.posexplode(vector).alias("i", "v")).groupBy(domain, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    a, b = x.select(F.col(domain).alias("domain_1"), "i", F.col("m").alias("p")), x.select(F.col(domain).alias("domain_2"), "i", F.col("m").alias("q"))
    return a.join(b, "i").where("domain_1 < domain_2").groupBy("domain_1", "domain_2").agg(div(F.sum(F.col("p") * F.col("q")), F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))).alias("coupling"))


def cohesion(vectors: DataFrame, domain: str = "domain", vector: str = "vector", key: str = "indicator_id") -> DataFrame:
    """1 / (1 + mean distance to the centroid) of each domain."""
    x = vectors.select(domain, key, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = x.groupBy(domain, "i").agg(F.avg("v").alias("m"))
    d = x.join(c, [domain, "i"]).groupBy(domain, key).agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("d"))
    return d.groupBy(domain).agg(F.avg("d").alias("mean_distance"), (1 / (1 + F.avg("d"))).alias("cohesion"), F.count("*").alias("n"))
