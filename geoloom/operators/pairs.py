"""Relations between two series with a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.mathx import div, normal_sf, safe_corr
from geoloom.operators.joins import pairs_on_date
from geoloom.operators.panel import average_rank, discretise

PAIR = ("id_1", "id_2")


def correlation_pairs(panel: DataFrame, extra_keys: tuple[str, ...] = (), min_obs: int = 2) -> DataFrame:
    """Upper triangle as rows: corr over common dates, and their number."""
    out = pairs_on_date(panel, extra_keys).groupBy(*extra_keys, *PAIR).agg(safe_corr(F.col("x"), F.col("y")).alias("corr"), F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("long")).alias("n_obs"))
    return out.where(F.col("n_obs") >= min_obs)


def correlation_summary(corr: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean |r|, strongest and weakest pair with signed value; ties by id."""
    place = lambda sign: F.struct(sign * F.abs("corr"), F.col("id_1"), F.col("id_2"))
    pair = F.struct("id_1", "id_2", "corr")
    g = corr.where(F.col("corr").isNotNull()).groupBy(*keys).agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), F.count("*").alias("n_pairs"), F.min_by(pair, place(F.lit(-1.0))).alias("s"), F.min_by(pair, place(F.lit(1.0))).alias("w"))
    return g.select(*keys, "mean_abs_corr", "n_pairs", F.col("s.id_1").alias("strong_1"), F.col("s.id_2").alias("strong_2"), F.col("s.corr").alias("strong_corr"), F.col("w.id_1").alias("weak_1"), F.col("w.id_2").alias("weak_2"), F.col("w.corr").alias("weak_corr"))


def strong_pairs(corr: DataFrame, threshold: float = 0.6, most: int | None = 200, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with |r| at least the threshold, the ``most`` strongest of each window (a report's limit; None for all)."""
    hit = corr.where(F.abs("corr") >= threshold)
    if most is None:
        return hit
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("corr")), "id_1", "id_2")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def cross_correlation(panel: DataFrame, max_lag: int = 20) -> DataFrame:
    """(id_1, id_2, lag, ccf, n): lag > 0 means that the first series leads.  All lags of a pair come from one Arrow group."""
    from geoloom.kernels.pair import lagged_correlations
    from geoloom.operators.grouped import arrow_groups

    def lags(_, table):
        table = table.sort_by("date")
        return [(k, None if c != c else c, n) for k, c, n in lagged_correlations(table["x"].to_numpy(), table["y"].to_numpy(), max_lag)]

    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*PAIR, "date", "x", "y")
    return arrow_groups(both, PAIR, "lag int, ccf double, n long", lags)


def best_lag(ccf: DataFrame) -> DataFrame:
    """Peak of |ccf| (ties: the first lag), zero-lag value, decay, mean |ccf|, who leads, and significance 2/sqrt(n)."""
    rows = ccf.where(F.col("ccf").isNotNull())
    g = rows.groupBy(*PAIR).agg(
        F.min_by("lag", F.struct(-F.abs("ccf"), F.col("lag"))).alias("peak_lag"), F.min_by("ccf", F.struct(-F.abs("ccf"), F.col("lag"))).alias("peak_corr"), F.max(F.when(F.col("lag") == 0, F.col("ccf"))).alias("zero_lag_corr"),
        F.avg(F.abs("ccf")).alias("mean_abs_ccf"), F.max(F.when(F.col("lag") == 0, F.col("n"))).alias("n_obs"),
    )
    lead = F.when(F.col("peak_lag") > 0, F.col("id_1")).when(F.col("peak_lag") < 0, F.col("id_2"))
    return g.withColumn("leader", lead).withColumn("decay", F.abs("peak_corr") - F.col("mean_abs_ccf")).withColumn("significant", F.abs("peak_corr") > 2 / F.sqrt(F.col("n_obs").cast("double")))


def lead_counts(best: DataFrame) -> DataFrame:
    return best.agg(F.sum((F.col("peak_lag") > 0).cast("int")).alias("n_leading"), F.sum((F.col("peak_lag") < 0).cast("int")).alias("n_lagging"), F.sum((F.col("peak_lag") == 0).cast("int")).alias("n_synchronous"))


def mutual_information(panel: DataFrame, n_bins: int = 8, method: str = "quantile") -> DataFrame:
    """MI in nats over binned values, NMI by the arithmetic mean of entropies, and MI where |r| is small.

    Values are binned once and paired once; cells carry the sums that the
    correlation needs, taken about the series' means.
    """
    binned = discretise(panel.where(F.col("value").isNotNull()), n_bins, method)
    centred = binned.select("date", "indicator_id", F.struct("bin", (F.col("value") - F.avg("value").over(Window.partitionBy("indicator_id"))).alias("v")).alias("value"))
    both = pairs_on_date(centred)
    x, y = F.col("x.v"), F.col("y.v")
    joint = both.groupBy(*PAIR, F.col("x.bin").alias("b1"), F.col("y.bin").alias("b2")).agg(F.count("*").cast("double").alias("c"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    pair = Window.partitionBy(*PAIR)
    joint = joint.withColumn("n", F.sum("c").over(pair)).withColumn("c1", F.sum("c").over(Window.partitionBy(*PAIR, "b1"))).withColumn("c2", F.sum("c").over(Window.partitionBy(*PAIR, "b2")))
    p = F.col("c") / F.col("n")
    # each margin's entropy: its terms are spread over the joint cells in proportion
    h = lambda m: -F.sum(p * F.ln(F.col(m) / F.col("n")))
    n = F.sum("c")
    cov, vx, vy = F.sum("sxy") - F.sum("sx") * F.sum("sy") / n, F.sum("sxx") - F.sum("sx") * F.sum("sx") / n, F.sum("syy") - F.sum("sy") * F.sum("sy") / n
    corr = div(cov, F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0)))
    out = joint.groupBy(*PAIR).agg(F.sum(p * F.ln(F.col("c") * F.col("n") / (F.col("c1") * F.col("c2")))).alias("mi"), h("c1").alias("h1"), h("c2").alias("h2"), F.max("n").cast("long").alias("n_obs"), corr.alias("corr"))
    return out.withColumn("nmi", div(2 * F.col("mi"), F.col("h1") + F.col("h2"))).withColumn("nonlinear_excess", F.when(F.abs("corr") < 0.3, F.col("mi")))


def transfer_entropy(panel: DataFrame, n_bins: int = 8, lag: int = 1) -> DataFrame:
    """(source, target, te): bits about the target's next bin in the source's past beyond the target's own past."""
    binned = discretise(panel.where(F.col("value").isNotNull()), n_bins)
    a = binned.select("date", F.col("indicator_id").alias("source"), F.col("bin").alias("s"))
    b = binned.select("date", F.col("indicator_id").alias("target"), F.col("bin").alias("t"))
    line = Window.partitionBy("source", "target").orderBy("date")
    rows = a.join(b, "date").where("source <> target").withColumn("next", F.lead("t", lag).over(line)).where(F.col("next").isNotNull())
    c = rows.groupBy("source", "target", "next", "t", "s").agg(F.count("*").cast("double").alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy("source", "target", *k))
    c = c.withColumns({"n": over(), "c_t": over("t"), "c_nt": over("next", "t"), "c_ts": over("t", "s")})
    te = F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("c_t") / (F.col("c_nt") * F.col("c_ts"))))
    return c.groupBy("source", "target").agg(te.alias("te"), F.max("n").cast("long").alias("n_obs"))


def net_flow(te: DataFrame) -> DataFrame:
    """Outgoing minus incoming transfer entropy of each series, in order of influence."""
    out = te.groupBy(F.col("source").alias("indicator_id")).agg(F.sum("te").alias("outgoing"))
    inc = te.groupBy(F.col("target").alias("indicator_id")).agg(F.sum("te").alias("incoming"))
    flow = out.join(inc, "indicator_id", "full").select("indicator_id", F.coalesce("outgoing", F.lit(0.0)).alias("outgoing"), F.coalesce("incoming", F.lit(0.0)).alias("incoming"))
    return flow.withColumn("net", F.col("outgoing") - F.col("incoming")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("net"), "indicator_id")))


def rank_dependence(panel: DataFrame, tails: tuple[float, ...] = (0.05, 0.10, 0.15), high: float = 0.9) -> DataFrame:
    """Spearman's rho, tail dependence averaged over ``tails``, asymmetry, joint exceedance above ``high``."""
    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = both.withColumn("n", F.count("*").over(Window.partitionBy(*PAIR)).cast("double"))
    ranked = ranked.withColumn("rx", average_rank(F.col("x"), PAIR)).withColumn("ry", average_rank(F.col("y"), PAIR))
    u, v = F.col("rx") / (F.col("n") + 1), F.col("ry") / (F.col("n") + 1)
    lower = [div(F.sum(((u <= q) & (v <= q)).cast("double")), F.sum((u <= q).cast("double"))) for q in tails]
    upper = [div(F.sum(((u >= 1 - q) & (v >= 1 - q)).cast("double")), F.sum((u >= 1 - q).cast("double"))) for q in tails]
    mean = lambda cols: sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / len(cols)
    out = ranked.groupBy(*PAIR).agg(F.count("*").alias("n_obs"), safe_corr(F.col("rx"), F.col("ry")).alias("spearman"), mean(lower).alias("lower_tail"), mean(upper).alias("upper_tail"), F.avg(((u > high) & (v > high)).cast("double")).alias("joint_exceedance"))
    out = out.withColumn("spearman_p", 2 * normal_sf(F.abs("spearman") * F.sqrt(F.col("n_obs").cast("double") - 1)))
    return out.withColumn("tail_asymmetry", F.col("upper_tail") - F.col("lower_tail"))


def kendall(panel: DataFrame) -> DataFrame:
    """Kendall's tau-b by counting inversions, its p by the normal approximation; Gumbel and Clayton parameters."""
    from geoloom.operators.grouped import order_counts

    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*PAIR, "x", "y")
    g = order_counts(both, PAIR).where("n > 1")
    tau = div(F.col("s").cast("double"), F.sqrt(F.col("nx").cast("double") * F.col("ny").cast("double")))
    n = F.col("n").cast("double")
    p = 2 * normal_sf(F.abs(3 * F.col("tau") * F.sqrt(n * (n - 1)) / F.sqrt(2 * (2 * n + 5))))
    out = g.select(*PAIR, "n", F.col("s").alias("kendall_s"), tau.alias("tau")).withColumn("tau_p", p).drop("n")
    return out.withColumn("gumbel_theta", F.when(F.col("tau") < 1, div(F.lit(1.0), 1 - F.col("tau")))).withColumn("clayton_theta", F.when(F.col("tau") < 1, div(2 * F.col("tau"), 1 - F.col("tau"))))


def bonferroni(tall: DataFrame, prefix: str = "granger_p", alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """p-values of tall descriptors against alpha over their number (in each of ``keys``)."""
    rows = tall.where(F.col("dimension").startswith(prefix))
    limit = F.lit(alpha) / F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("threshold", limit).withColumn("significant", F.col("value") < F.col("threshold"))


def distances(panel: DataFrame) -> DataFrame:
    """Euclidean, cosine and correlation (1 - |r|) distance of (z-scored) series on common dates."""
    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    d = F.col("x") - F.col("y")
    g = both.groupBy(*PAIR).agg(F.sqrt(F.sum(d * d)).alias("euclidean"), (1 - div(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))).alias("cosine"), (1 - F.abs(safe_corr(F.col("x"), F.col("y")))).alias("correlation"))
    return g


def spread(panel: DataFrame) -> DataFrame:
    """Hedge ratio of y on x, deviation, last z-score and half-life of the spread y - alpha - beta x."""
    both = pairs_on_date(panel).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    every = Window.partitionBy(*PAIR)
    both = both.withColumn("mx", F.avg("x").over(every)).withColumn("my", F.avg("y").over(every))
    both = both.withColumn("beta", div(F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))).over(every), F.sum((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))).over(every)))
    both = both.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx")).withColumn("s", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    both = both.withColumn("before", F.lag("s").over(every.orderBy("date"))).withColumn("ds", F.col("s") - F.col("before"))
    lam = div(F.covar_pop(F.when(F.col("ds").isNotNull(), F.col("before")), F.col("ds")), F.var_pop(F.when(F.col("ds").isNotNull(), F.col("before"))))
    g = both.groupBy(*PAIR).agg(F.first("beta").alias("hedge_ratio"), F.first("alpha").alias("alpha"), F.stddev_pop("s").alias("spread_std"), F.max_by("s", "date").alias("last"), lam.alias("lam"))
    return g.select(*PAIR, "hedge_ratio", "alpha", "spread_std", div(F.col("last"), F.col("spread_std")).alias("spread_z"), F.when(F.col("lam") < 0, -F.ln(F.lit(2.0)) / F.col("lam")).alias("half_life"))


def network(corr: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Degree, mean |r| (centrality) and isolation of each series in the thresholded graph."""
    both = corr.select(F.col("id_1").alias("indicator_id"), F.abs("corr").alias("r")).unionByName(corr.select(F.col("id_2").alias("indicator_id"), F.abs("corr").alias("r")))
    g = both.groupBy("indicator_id").agg(F.sum((F.col("r") >= threshold).cast("int")).alias("degree"), F.avg("r").alias("mean_abs_corr"), F.max("r").alias("max_abs_corr"), F.count("*").alias("n_others"))
    return g.withColumn("isolation", 1 - F.col("mean_abs_corr")).withColumn("degree_share", div(F.col("degree").cast("double"), F.col("n_others").cast("double")))


def density(corr: DataFrame, threshold: float = 0.6) -> DataFrame:
    return corr.agg(F.avg((F.abs("corr") >= threshold).cast("double")).alias("density"), F.avg(F.abs("corr")).alias("mean_abs_corr"), F.count("*").alias("n_pairs"))
