"""Per-series descriptors with a closed form: window and aggregate expressions only.

Every function takes a panel and the columns that identify a series
(indicator_id, and window_id where windows were assigned), and returns one row
a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import EPS, chi2_sf_even, div, ln_pos, normal_sf, safe_corr

KEYS = ("indicator_id",)


def _line(keys):
    return Window.partitionBy(*keys).orderBy("date")


def _numbered(panel: DataFrame, keys) -> DataFrame:
    return panel.where(F.col("value").isNotNull()).withColumn("rn", (F.row_number().over(_line(keys)) - 1).cast("double"))


def _returns(panel: DataFrame, keys) -> DataFrame:
    before = F.lag("value").over(_line(keys))
    return panel.where(F.col("value").isNotNull()).withColumn("r", (F.col("value") - before) / (F.abs(before) + F.lit(EPS)))


def basic_stats(panel: DataFrame, keys=KEYS, min_obs: int = 10) -> DataFrame:
    """Level and return moments and quantiles; skewness and kurtosis are those of the population, kurtosis in excess."""
    before = F.lag("value").over(_line(keys))
    rows = _returns(panel, keys).withColumn("lr", ln_pos(F.col("value")) - ln_pos(before))
    points = (5, 25, 50, 75, 95)
    aggs = [
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"), F.count("value").alias("n_obs"),
        F.percentile("value", F.array(*[F.lit(p / 100) for p in points])).alias("__q"),  # one buffer of values for all points
        F.avg("r").alias("return_mean"), F.stddev_pop("r").alias("return_std"), F.min("r").alias("return_min"), F.max("r").alias("return_max"), F.skewness("r").alias("return_skew"), F.kurtosis("r").alias("return_kurtosis"),
        F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("downside_std"), F.avg("lr").alias("log_return_mean"), F.stddev_pop("lr").alias("log_return_std"),
    ]
    out = rows.groupBy(*keys).agg(*aggs).where(F.col("n_obs") >= min_obs)
    quantiles = {("median" if p == 50 else f"q{p:02d}"): F.get("__q", F.lit(i)) for i, p in enumerate(points)}
    return out.withColumns(quantiles).drop("__q")


def rolling_self_beta(panel: DataFrame, keys=KEYS, window: int = 21) -> DataFrame:
    """Mean and deviation of the beta of returns on their own lag over rolling windows."""
    line = _line(keys)
    rows = _returns(panel, keys).where(F.col("r").isNotNull()).withColumn("before", F.lag("r").over(line))
    w = line.rowsBetween(-(window - 2), 0)
    beta = F.when(F.count("before").over(w) == window - 1, div(F.covar_samp("r", "before").over(w), F.var_pop("before").over(w)))
    return rows.withColumn("beta", beta).groupBy(*keys).agg(F.avg("beta").alias("self_beta_mean"), F.stddev_pop("beta").alias("self_beta_std"), F.count("beta").alias("n_windows"))


def autocorrelation(panel: DataFrame, max_lag: int = 20, keys=KEYS) -> DataFrame:
    """(keys, lag, acf): sum of products of deviations at a lag over the sum of squares."""
    every = Window.partitionBy(*keys)
    line = _line(keys)
    rows = panel.where(F.col("value").isNotNull()).withColumn("d", F.col("value") - F.avg("value").over(every))
    products = [F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)]
    lagged = rows.withColumns({f"l{k}": F.lag("d", k).over(line) for k in range(1, max_lag + 1)})
    sums = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("ss"), *products)
    lags = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), div(F.col(f"s{k}"), F.col("ss")).alias("acf")) for k in range(1, max_lag + 1)])).alias("x")
    return sums.select(*keys, "n", lags).select(*keys, "n", "x.lag", "x.acf")


def ljung_box(acf: DataFrame, keys=KEYS, max_lag: int = 20) -> DataFrame:
    """Mean |acf|, Q and its p (an even number of lags, ``max_lag``), the first lag at which the acf is not positive, and lags beyond 2/sqrt(n)."""
    n = F.col("n").cast("double")
    out = acf.groupBy(*keys, "n").agg(
        F.avg(F.abs("acf")).alias("mean_abs_acf"), (n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag")))).alias("ljung_box_q"), F.min(F.when(F.col("acf") <= 0, F.col("lag"))).alias("first_zero"),
        F.sum((F.abs("acf") > 2 / F.sqrt(n)).cast("int")).alias("significant_lags"),
    )
    return out.withColumn("ljung_box_p", chi2_sf_even(F.col("ljung_box_q"), max_lag))


def trend(panel: DataFrame, keys=KEYS) -> DataFrame:
    """OLS slope on the row number, slope over the range, R2, deviation and range of the residual, quadratic coefficient."""
    rows = _numbered(panel, keys)
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("t", F.col("rn") - F.avg("rn").over(every)).withColumn("v", F.col("value") - F.avg("value").over(every))
    rows = rows.withColumn("slope", div(F.sum(F.col("t") * F.col("v")).over(every), F.sum(F.col("t") * F.col("t")).over(every)))
    rows = rows.withColumn("e", F.col("v") - F.col("slope") * F.col("t")).withColumn("t2", F.col("t") * F.col("t") - F.avg(F.col("t") * F.col("t")).over(every))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.first("slope").alias("trend_slope"), (F.first("slope") * F.count("*") / (F.max("value") - F.min("value") + F.lit(EPS))).alias("trend_slope_normalized"),
        (F.lit(1.0) - F.sum(F.col("e") * F.col("e")) / (F.sum(F.col("v") * F.col("v")) + F.lit(EPS))).alias("trend_r_squared"),
        div(F.sum(F.col("t2") * F.col("v")), F.sum(F.col("t2") * F.col("t2"))).alias("trend_quadratic_coef"),
        F.stddev_pop("e").alias("detrended_std"), (F.max("e") - F.min("e")).alias("detrended_range"),
    )


def mann_kendall(panel: DataFrame, keys=KEYS) -> DataFrame:
    """S (later-larger minus later-smaller pairs, by counting inversions) and z."""
    from geoloom.operators.grouped import order_counts

    counts = order_counts(_numbered(panel, keys).select(*keys, F.col("rn").alias("x"), F.col("value").alias("y")), keys)
    n = F.col("n").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18
    s = F.col("s")
    return counts.where("n > 1").select(*keys, "n", s.alias("mk_s"), F.when(s > 0, (s - 1) / F.sqrt(var)).when(s < 0, (s + 1) / F.sqrt(var)).otherwise(0.0).alias("mk_z"))


def volatility(panel: DataFrame, keys=KEYS, window: int = 21) -> DataFrame:
    """Realised, annualised, rolling, downside and upside volatility, arch autocorrelation, drawdown, Calmar ratio."""
    line = _line(keys)
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = _returns(panel, keys)
    w = line.rowsBetween(-(window - 1), 0)
    rows = rows.where(F.col("r").isNotNull()).withColumn("rv", F.when(F.count("r").over(w) == window, F.stddev_pop("r").over(w)))
    # the reference frame excludes the last return of the series
    rows = rows.withColumn("rv", F.when(F.lead("r").over(line).isNotNull(), F.col("rv")))
    rows = rows.withColumn("wealth", F.when(F.min(F.col("r") + 1).over(run) > 0, F.exp(F.sum(F.when(F.col("r") > -1, F.log1p("r"))).over(run))))
    rows = rows.withColumn("dd", div(F.col("wealth") - F.max("wealth").over(run), F.max("wealth").over(run))).withColumn("sq", F.col("r") * F.col("r"))
    rows = rows.withColumn("sq_before", F.lag("sq").over(line))
    neg, pos = F.when(F.col("r") < 0, F.col("r")), F.when(F.col("r") > 0, F.col("r"))
    out = rows.groupBy(*keys).agg(
        F.stddev_pop("r").alias("realized_volatility"), (F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("annualized_volatility"), F.avg("rv").alias("volatility_mean"), F.stddev_pop("rv").alias("volatility_std"),
        F.min("rv").alias("volatility_min"), F.max("rv").alias("volatility_max"), (F.max("rv") - F.min("rv")).alias("volatility_range"), div(F.stddev_pop("rv"), F.avg("rv")).alias("vol_of_vol"),
        safe_corr(F.col("sq"), F.col("sq_before")).alias("arch_autocorr"), F.stddev_pop(neg).alias("downside_volatility"), F.sqrt(F.avg(neg * neg)).alias("sortino_denominator"), F.stddev_pop(pos).alias("upside_volatility"),
        div(F.stddev_pop(pos), F.stddev_pop(neg) + F.lit(EPS)).alias("volatility_skew"), F.min("dd").alias("max_drawdown"), (F.avg("r") * 252).alias("__annual"),
    )
    return out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") < 0, div(F.col("__annual"), F.abs("max_drawdown")))).drop("__annual")


def parkinson(panel: DataFrame, keys=KEYS, block: int = 5) -> DataFrame:
    """Mean range of full blocks over 2 sqrt(ln 2)."""
    rows = _numbered(panel, keys).withColumn("block", F.floor(F.col("rn") / F.lit(float(block)))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.where(F.col("block") * block < F.col("n") - block)
    ranges = rows.groupBy(*keys, "block").agg((F.max("value") - F.min("value")).alias("range"))
    return ranges.groupBy(*keys).agg((F.avg("range") / (2 * F.sqrt(F.ln(F.lit(2.0))))).alias("parkinson_volatility"))


def variance_ratio(panel: DataFrame, q: int = 4, keys=KEYS) -> DataFrame:
    """Variance of q-period log returns over q times that of one-period ones."""
    line = _line(keys)
    rows = panel.where("value > 0").withColumn("r", F.ln("value") - F.lag(F.ln("value")).over(line)).where(F.col("r").isNotNull())
    w = line.rowsBetween(-(q - 1), 0)
    rows = rows.withColumn("rq", F.when(F.count("r").over(w) == q, F.sum("r").over(w)))
    out = rows.groupBy(*keys).agg(div(F.var_pop("rq") / q, F.var_pop("r")).alias("variance_ratio"))
    vr = F.col("variance_ratio")
    return out.withColumn("verdict", F.when(F.abs(vr - 1) < 0.2, "random_walk_like").when(vr > 1.2, "positive_autocorr").when(vr.isNotNull(), "mean_reverting"))


def half_life(panel: DataFrame, keys=KEYS) -> DataFrame:
    """AR(1) slope and -ln 2 / ln slope where the slope is in (0, 1)."""
    rows = panel.where(F.col("value").isNotNull()).withColumn("before", F.lag("value").over(_line(keys))).where(F.col("before").isNotNull())
    slope = div(F.covar_pop("before", "value"), F.var_pop("before"))
    return rows.groupBy(*keys).agg(slope.alias("ar1_slope")).withColumn("half_life", F.when((F.col("ar1_slope") > 0) & (F.col("ar1_slope") < 1), F.lit(-1.0) * F.ln(F.lit(2.0)) / F.ln("ar1_slope")))


def window_stability(panel: DataFrame, keys=KEYS) -> DataFrame:
    """Deviation over level of the means and of the variances of half-overlapping windows of min(n/4, 50) rows."""
    rows = _numbered(panel, keys).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    size = F.least(F.floor(F.col("n") / 4), F.lit(50)).cast("int")
    step = F.greatest(F.floor(size / 2), F.lit(1)).cast("int")
    rows = rows.withColumn("size", size).withColumn("step", step).where("size > 1")
    first = F.greatest(F.ceil((F.col("rn") - F.col("size") + 1) / F.col("step")), F.lit(0))
    last = F.least(F.floor(F.col("rn") / F.col("step")), F.ceil((F.col("n") - F.col("size")) / F.col("step")) - 1)
    hit = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    per = hit.groupBy(*keys, "k").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n_windows"), (F.stddev_pop("m") / (F.avg(F.abs("m")) + F.lit(EPS))).alias("rolling_mean_stability"), (F.stddev_pop("v") / (F.avg("v") + F.lit(EPS))).alias("rolling_var_stability"))
    return out.where("n_windows > 2")


def hurst_rs(panel: DataFrame, preset: str = "diff", keys=KEYS) -> DataFrame:
    """Rescaled range.

    Presets: ``diff`` (differences, sizes 8..min(n/2,100) in steps, sample
    deviation, clipped to [0,1]), ``quarters`` (levels, sizes n/2, n/4, n/8,
    n/16 of 10 and more, population deviation) and ``geometric`` (levels, sizes
    20 * 1.5^k up to n/4, sample deviation, three sizes at least).
    """
    line = _line(keys)
    rows = panel.where(F.col("value").isNotNull())
    if preset == "diff":
        rows = rows.withColumn("x", F.col("value") - F.lag("value").over(line)).where(F.col("x").isNotNull())
    else:
        rows = rows.withColumn("x", F.col("value"))
    rows = rows.withColumn("rn", F.row_number().over(line) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    if preset == "diff":
        top = F.least(F.floor(F.col("n") / 2), F.lit(100)).cast("int")
        sizes = F.when(top >= 8, F.sequence(F.lit(8), top, F.greatest(F.floor(top / 20), F.lit(1)).cast("int")))
        sd = F.stddev_samp("x")
    elif preset == "quarters":
        sizes = F.filter(F.array(*[F.floor(F.col("n") / k).cast("int") for k in (2, 4, 8, 16)]), lambda s: s >= 10)
        sd = F.stddev_pop("x")
    else:
        steps = [20]
        while steps[-1] < 1 << 30:
            steps.append(int(steps[-1] * 1.5))
        sizes = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= F.floor(F.col("n") / 4))
        sd = F.stddev_samp("x")
    seg = rows.withColumn("size", F.explode(sizes)).withColumn("seg", F.floor(F.col("rn") / F.col("size"))).where((F.col("seg") + 1) * F.col("size") <= F.col("n"))
    part = Window.partitionBy(*keys, "size", "seg")
    walk = seg.withColumn("d", F.col("x") - F.avg("x").over(part)).withColumn("y", F.sum("d").over(part.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    rs = walk.groupBy(*keys, "size", "seg").agg((F.max("y") - F.min("y")).alias("range"), sd.alias("sd")).where(F.col("sd") > EPS)
    by_size = rs.groupBy(*keys, "size").agg(F.avg(F.col("range") / F.col("sd")).alias("rs")).where("rs > 0")
    h = div(F.covar_pop(F.ln(F.col("size").cast("double")), F.ln("rs")), F.var_pop(F.ln(F.col("size").cast("double"))))
    out = by_size.groupBy(*keys).agg(h.alias("hurst"), F.count("*").alias("n_sizes"))
    if preset == "diff":
        out = out.withColumn("hurst", F.when(F.col("n_sizes") < 3, 0.5).otherwise(F.least(F.greatest("hurst", F.lit(0.0)), F.lit(1.0))))
        label = F.when(F.col("hurst") < 0.4, "mean_reverting").when(F.col("hurst") > 0.6, "trending").otherwise("random_walk")
    elif preset == "quarters":
        label = F.when(F.col("hurst") > 0.5, "persistent").when(F.col("hurst") < 0.5, "anti_persistent").otherwise("random_walk")
    else:
        out = out.where("n_sizes >= 3")
        label = F.when(F.col("hurst") > 0.55, "trending").when(F.col("hurst") < 0.45, "mean_reverting").otherwise("random_walk")
    return out.withColumn("label", label)


def dfa(panel: DataFrame, scales: tuple[int, ...] = (4, 8, 16, 32, 64), keys=KEYS) -> DataFrame:
    """Detrended fluctuation: slope of ln F on ln scale; F from residuals of a line in each segment of the walk."""
    line = _line(keys)
    every = Window.partitionBy(*keys)
    rows = panel.where(F.col("value").isNotNull()).withColumn("d", F.col("value") - F.avg("value").over(every)).withColumn("y", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("rn", F.row_number().over(line) - 1).withColumn("n", F.count("*").over(every))
    seg = rows.withColumn("scale", F.explode(F.filter(F.array(*[F.lit(s) for s in scales]), lambda s: s * 4 <= F.col("n"))))
    seg = seg.withColumn("seg", F.floor(F.col("rn") / F.col("scale"))).where((F.col("seg") + 1) * F.col("scale") <= F.col("n")).withColumn("t", (F.col("rn") % F.col("scale")).cast("double"))
    rss = F.var_pop("y") - div(F.covar_pop("t", "y") * F.covar_pop("t", "y"), F.var_pop("t"))
    per = seg.groupBy(*keys, "scale", "seg").agg(F.greatest(rss, F.lit(0.0)).alias("rss"))
    by_scale = per.groupBy(*keys, "scale").agg(F.sqrt(F.avg("rss")).alias("fluct")).where("fluct > 0")
    x = F.ln(F.col("scale").cast("double"))
    return by_scale.groupBy(*keys).agg(div(F.covar_pop(x, F.ln("fluct")), F.var_pop(x)).alias("hurst_dfa"))


def shannon_entropy(binned: DataFrame, keys=KEYS) -> DataFrame:
    """Entropy in bits of the bins of ``panel.discretise``."""
    p = binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("shannon_entropy"), F.count("*").alias("n_bins"))


def permutation_entropy(panel: DataFrame, keys=KEYS) -> DataFrame:
    """Order 3, delay 1, over log2(3!); ties go to the earlier place."""
    line = _line(keys)
    a, b, c = F.col("value"), F.lead("value", 1).over(line), F.lead("value", 2).over(line)
    rows = panel.where(F.col("value").isNotNull()).select(*keys, a.alias("a"), b.alias("b"), c.alias("c")).where("c IS NOT NULL")
    pattern = (F.col("a") > F.col("b")).cast("int") * 4 + (F.col("a") > F.col("c")).cast("int") * 2 + (F.col("b") > F.col("c")).cast("int")
    p = rows.groupBy(*keys, pattern.alias("pattern")).agg(F.count("*").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(6.0))).alias("permutation_entropy"))


def sample_entropy(panel: DataFrame, m: int = 2, r: float = 0.2, keys=KEYS) -> DataFrame:
    """-ln(A/B): pairs of m + 1 and m values within r deviations, counted in an Arrow kernel along the sorted first values."""
    from geoloom.kernels.series import near_templates
    from geoloom.operators.grouped import arrow_rows

    def count(v):
        tol = r * float(v.std())
        near = near_templates(v, m, tol) if len(v) > m else (0, 0)
        return [near[1], near[0]]

    out = arrow_rows(panel.where(F.col("value").isNotNull()), keys, "a long, b long", count)
    return out.where("b > 0").select(*keys, "a", "b", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))).alias("sample_entropy"))


def recurrence_rate(panel: DataFrame, percentile: float = 0.1, keys=KEYS) -> DataFrame:
    """Share of pairs (i < j) nearer than a fraction of the range, counted along the sorted values."""
    from geoloom.kernels.series import near_pairs
    from geoloom.operators.grouped import arrow_rows

    def share(v):
        n = len(v)
        return [near_pairs(v, percentile * float(v.max() - v.min())) / (n * (n - 1) / 2) if n > 1 else None]

    return arrow_rows(panel.where(F.col("value").isNotNull()), keys, "recurrence_rate double", share).where("recurrence_rate IS NOT NULL")


def garch_heuristic(panel: DataFrame, persistence: float = 0.9, keys=KEYS) -> DataFrame:
    """Variance parameters from the lag-1 autocorrelation of squared returns (in percent): alpha in [0.05, 0.3], beta = persistence - alpha."""
    line = _line(keys)
    before = F.lag("value").over(line)
    rows = panel.where(F.col("value").isNotNull()).withColumn("r", div(F.col("value") - before, before) * 100).where(F.col("r").isNotNull())
    rows = rows.withColumn("e", F.col("r") - F.avg("r").over(Window.partitionBy(*keys))).withColumn("sq", F.col("e") * F.col("e")).withColumn("sq_before", F.lag("sq").over(line))
    out = rows.groupBy(*keys).agg(F.coalesce(safe_corr(F.col("sq"), F.col("sq_before")), F.lit(0.0)).alias("acf1_sq"), F.var_pop("r").alias("uncond_variance"), F.count("*").alias("n_obs"))
    alpha = F.least(F.greatest(F.lit(0.5) * F.col("acf1_sq"), F.lit(0.05)), F.lit(0.3))
    return out.withColumn("alpha", alpha).withColumn("beta", F.lit(persistence) - alpha).withColumn("omega", F.col("uncond_variance") * F.lit(1 - persistence))


# ---- diagnostics of the geometry signature with a closed form


def signature_diagnostics(panel: DataFrame, keys=KEYS) -> DataFrame:
    """asymmetry, bounded accumulation, fat tails, volatility clustering, tail dependence, zero crossings, runs test, drift: scores in [0, 1] and their metrics."""
    line, every = _line(keys), Window.partitionBy(*keys)
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.where(F.col("value").isNotNull()).withColumn("rn", F.row_number().over(line)).withColumn("n", F.count("*").over(every)).withColumn("dx", F.col("value") - F.lag("value").over(line))
    rows = rows.withColumn("acc", F.sum(F.col("value") - F.avg("value").over(every)).over(run)).withColumn("peak", F.min_by("rn", -F.col("value")).over(every)).withColumn("sq", F.col("dx") * F.col("dx"))
    rows = rows.withColumn("sq_before", F.lag("sq").over(line)).withColumn("med", F.median("value").over(every)).withColumn("mean", F.avg("value").over(every)).withColumn("side", F.signum(F.col("value") - F.col("med")))
    rows = rows.withColumn("cut", F.percentile(F.abs("dx"), 0.9).over(every)).withColumn("extreme", F.abs("dx") >= F.col("cut")).withColumn("mside", F.signum(F.col("value") - F.col("mean")))
    rows = rows.withColumn("changed", (F.col("side") != F.lag("side").over(line)).cast("int")).withColumn("crossed", (F.col("mside") * F.lag("mside").over(line) < 0).cast("int"))
    slope = lambda ok: div(F.covar_pop(F.when(ok, F.col("rn").cast("double")), F.when(ok, F.col("value"))), F.var_pop(F.when(ok, F.col("rn").cast("double"))))
    half = F.col("n") / 2
    g = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.abs(slope(F.col("rn") <= F.col("peak"))).alias("rise"), F.abs(slope(F.col("rn") >= F.col("peak"))).alias("fall"),
        F.var_pop(F.when(F.col("rn") <= half, F.col("acc"))).alias("va"), F.var_pop(F.when(F.col("rn") > half, F.col("acc"))).alias("vb"), F.kurtosis("dx").alias("excess_kurtosis"), safe_corr(F.col("sq"), F.col("sq_before")).alias("arch_effect"),
        F.sum(F.col("extreme").cast("long")).alias("k"), F.min(F.when(F.col("extreme"), F.col("rn"))).alias("e1"), F.max(F.when(F.col("extreme"), F.col("rn"))).alias("e2"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"), F.sum((F.col("side") > 0).cast("long")).alias("np"), F.sum((F.col("side") <= 0).cast("long")).alias("nn"), F.avg("crossed").alias("crossing_rate"),
        F.avg("dx").alias("drift"), F.stddev_pop("dx").alias("drift_sd"), (F.max_by("value", "rn") - F.min_by("value", "rn")).alias("net"),
    )
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    np_, nn = F.col("np").cast("double"), F.col("nn").cast("double")
    expected = 2 * np_ * nn / (np_ + nn) + 1
    var = 2 * np_ * nn * (2 * np_ * nn - np_ - nn) / ((np_ + nn) * (np_ + nn) * (np_ + nn - 1))
    return g.select(
        *keys, F.coalesce(unit(div(F.abs(F.col("rise") - F.col("fall")), F.col("rise") + F.col("fall"))), F.lit(0.0)).alias("asymmetry"),
        F.coalesce(unit(div(F.least("va", "vb"), F.greatest("va", "vb"))), F.lit(0.0)).alias("bounded_accumulation"), F.coalesce(unit(F.col("excess_kurtosis") / 6), F.lit(0.0)).alias("fat_tails"), "excess_kurtosis",
        F.coalesce(unit(F.col("arch_effect") * 2), F.lit(0.0)).alias("volatility_clustering"), "arch_effect",
        F.coalesce(unit(div((F.col("n") - 1) / F.col("k").cast("double"), div((F.col("e2") - F.col("e1")).cast("double"), (F.col("k") - 1).cast("double"))) - 1), F.lit(0.0)).alias("tail_dependence"),
        "crossing_rate", normal_sf(F.abs(div(F.col("net") / F.sqrt(F.col("n").cast("double")), F.col("drift_sd") + F.lit(EPS)))).__mul__(2).alias("drift_score"), F.when(var > 0, (F.col("changes") + 1 - expected) / F.sqrt(F.when(var > 0, var))).alias("runs_z"), div(F.col("drift") * F.sqrt(F.col("n").cast("double")), F.col("drift_sd")).alias("drift_t"),
    )


def tall(wide: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, dimension, value): descriptors as rows; NULL, NaN and infinities are left out."""
    values = [c for c, t in wide.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    out = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(keys), values, "dimension", "value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
