"""Quality gates, suitability, routing, contribution and exclusion: rules as expressions over small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import clip, div, safe_corr

# ---- fixed values: thresholds and tables of the policies

SUITABILITY = {
    "min_quality_score": 0.35, "min_confidence": 0.30, "max_disagreement": 0.65, "min_stability": 0.50, "min_observations": 10, "pure_noise_threshold": 0.70,
    "short_window_threshold": 1.5, "long_window_threshold": 5.0, "short_window_confidence_adj": -0.05, "short_window_stability_min": 0.60, "long_window_max_geometry_pct": 0.95,
}
UNIVERSAL = ["pca", "correlation", "entropy", "descriptive_stats"]
GEOMETRY_ENGINES = {
    "latent_flow": ["pca", "correlation", "entropy", "wavelets", "trend", "drift"],
    "reflexive_stochastic": ["pca", "correlation", "entropy", "hmm", "regime_detection", "volatility_clustering", "copula", "garch"],
    "coupled_oscillator": ["pca", "correlation", "entropy", "wavelets", "spectral", "phase_space", "dmd"],
    "pure_noise": [],
}
NOISE_ALLOWED = ["descriptive_stats", "null_check", "data_quality"]
CONTRIBUTION_WEIGHTS = {"geometric_influence": 0.30, "marginal_contribution": 0.20, "stability": 0.25, "noise_pressure": 0.15, "confidence_effect": 0.10}
MIN_WINDOW = {"pca": 60, "correlation": 60, "entropy": 100, "wavelets": 128, "granger": 120, "mutual_information": 200, "hmm": 200, "dmd": 100, "copula": 250, "rolling_beta": 60, "hurst": 500, "cointegration": 500, "sir": 84}
EXCLUDED = ["dtw", "rqa", "lyapunov", "fft"]
REQUIRES_NULL = ["mutual_information", "granger", "copula", "dtw", "rqa", "hurst", "cointegration"]
STATUS = {"core": ["pca", "correlation", "entropy", "wavelets"], "conditional": ["hmm", "dmd", "mutual_information", "copula", "granger", "rolling_beta", "sir"], "diagnostic": ["hurst", "cointegration"], "excluded": EXCLUDED}
ALIGNMENT = {"sir": [("latent_flow", 0.6)], "granger": [("oscillator", 0.5), ("latent_flow", 0.5)], "hmm": [("reflexive", 0.4)], "dmd": [("reflexive", 0.4)], "copula": [("reflexive", 0.4)]}
DOMAIN_FIT = {
    "pca": {"all": 1.0}, "correlation": {"all": 1.0}, "entropy": {"all": 1.0}, "wavelets": {"all": 1.0}, "hmm": {"all": 0.9}, "dmd": {"all": 0.8}, "mutual_information": {"all": 0.8}, "granger": {"climate": 1.0, "epidemiology": 1.0, "finance": 0.0},
    "copula": {"finance": 1.0, "climate": 0.0, "epidemiology": 0.0}, "rolling_beta": {"finance": 1.0, "climate": 0.0, "epidemiology": 0.0}, "sir": {"epidemiology": 1.0, "finance": 0.0, "climate": 0.0}, "hurst": {"all": 0.5},
    "cointegration": {"finance": 0.5, "climate": 0.0, "epidemiology": 0.0},
}
WEIGHT_CAP = 0.25


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# ---- Q1: quality of raw against cleaned data


def missing_gate(panel: DataFrame, multivariate: bool = True) -> DataFrame:
    """Missing rate; the gate is 5 % for panels and 10 % for single series."""
    limit = 0.05 if multivariate else 0.10
    return panel.groupBy("indicator_id").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"), F.count("*").alias("n")).withColumn("ok", F.col("missing_rate") <= limit)


def frequency_gate(panel: DataFrame, limit: float = 0.01) -> DataFrame:
    """Irregularity of spacing: deviation over median gap."""
    gaps = panel.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("indicator_id").orderBy("date"))))
    g = gaps.groupBy("indicator_id").agg(div(F.stddev_pop("gap"), F.nullif(F.median("gap"), F.lit(0.0))).alias("irregularity"), F.count("*").alias("n"))
    return g.withColumn("ok", F.coalesce(F.col("irregularity") <= limit, F.lit(True)))


def variance_collapse(both: DataFrame, limit: float = 0.5) -> DataFrame:
    """(indicator_id, raw, cleaned): variance ratio, and whether cleaning halved it or worse."""
    return both.groupBy("indicator_id").agg(div(F.var_samp("cleaned"), F.var_samp("raw")).alias("variance_ratio")).withColumn("collapsed", F.coalesce(F.col("variance_ratio") < limit, F.lit(False)))


#: Climate indices that must not be winsorised.  Fixed values.
CLIMATE_INDICES = ("enso", "nao", "pdo", "soi", "mei", "oni", "amo", "ao")


def outlier_policy(both: DataFrame, tail: float = 0.02, order: str | None = None) -> DataFrame:
    """Log transform (correlation with ln raw above .95 and not linear) and winsorising (range shrunk by over 5 %, or flat tails of 2 %); climate indices must not be winsorised.

    A tail is flat if its values lie within 1 % of the next one inwards.  An
    optional ``domain`` column says where an indicator belongs.
    """
    ln_raw = F.when(F.col("raw") > 0, F.ln("raw"))
    w = Window.partitionBy("indicator_id")
    rows = both.withColumn("__n", F.count("cleaned").over(w)).withColumn("__k", F.greatest(F.floor(F.col("__n") * tail), F.lit(1)).cast("int"))
    rows = rows.withColumn("__up", F.row_number().over(w.orderBy(F.col("cleaned").asc_nulls_last()))).withColumn("__down", F.row_number().over(w.orderBy(F.col("cleaned").desc_nulls_last())))
    inner = lambda c: F.max(F.when(F.col(c) == F.col("__k") + 1, F.col("cleaned")))
    edge = lambda c, f: f(F.when(F.col(c) <= F.col("__k"), F.col("cleaned")))
    near = lambda a, b: F.abs(a - b) <= 0.01 * F.abs(b) + 1e-8
    g = rows.groupBy("indicator_id").agg(
        safe_corr(ln_raw, F.col("cleaned")).alias("log_corr"), safe_corr(F.col("raw"), F.col("cleaned")).alias("level_corr"), (1 - div(F.max("cleaned") - F.min("cleaned"), F.max("raw") - F.min("raw"))).alias("range_shrink"), F.max("__n").alias("n"),
        F.coalesce(near(edge("__up", F.min), inner("__up")), F.lit(False)).alias("flat_low"), F.coalesce(near(edge("__down", F.max), inner("__down")), F.lit(False)).alias("flat_high"),
        *([F.first("domain").alias("domain")] if "domain" in both.columns else []),
    )
    out = g.withColumn("log_transformed", F.coalesce((F.col("log_corr") > 0.95) & (F.col("level_corr") < F.col("log_corr")), F.lit(False)))
    out = out.withColumn("winsorised", (F.col("n") >= 10) & (F.coalesce(F.col("range_shrink") > 0.05, F.lit(False)) | F.col("flat_low") | F.col("flat_high")))
    climate = F.lower("indicator_id").isin(list(CLIMATE_INDICES)) | (F.coalesce("domain", F.lit("")) == "climate" if "domain" in both.columns else F.lit(False))
    return out.withColumn("climate", climate).withColumn("compliant", ~(climate & F.col("winsorised")))


def stationarity_forcing(both: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(indicator_id, date, raw, cleaned): p-values of a unit-root test before and after cleaning, and whether cleaning forced stationarity."""
    import numpy as np

    from geoloom.kernels.pair import forced_stationarity
    from geoloom.operators.grouped import arrow_groups

    def judge(_, table):
        table = table.sort_by("date")
        got = forced_stationarity(*(np.asarray(table[c].to_numpy(), float) for c in ("raw", "cleaned")), alpha)
        return [(got["raw_p"], got["cleaned_p"], bool(got["forced"]))]

    return arrow_groups(both.select("indicator_id", "date", "raw", "cleaned"), ("indicator_id",), "raw_p double, cleaned_p double, forced boolean", judge)


def scaling_kind(panel: DataFrame) -> DataFrame:
    """zscore, robust_z, rank or none, from moments, median and MAD."""
    med = panel.withColumn("med", F.median("value").over(Window.partitionBy("indicator_id")))
    g = med.groupBy("indicator_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("med").alias("median"), F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    kind = F.when((F.abs("mean") < 0.1) & (F.abs(F.col("sd") - 1) < 0.1), "zscore").when((F.abs("median") < 0.1) & (F.abs(F.col("mad") * 1.4826 - 1) < 0.1), "robust_z").when((F.col("lo") >= 0) & (F.col("hi") <= 1) & (F.abs(F.col("mean") - 0.5) < 0.05), "rank").otherwise("none")
    return g.withColumn("scaling", kind)


def ks_shift(both: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov distance of raw and cleaned values, against its critical value."""
    long = both.select("indicator_id", F.col("raw").alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(both.select("indicator_id", F.col("cleaned").alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))).where(F.col("v").isNotNull())
    per = long.groupBy("indicator_id", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run, every = Window.partitionBy("indicator_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("indicator_id")
    cdf = per.select("indicator_id", F.sum("r").over(every).alias("nr"), F.sum("c").over(every).alias("nc"), F.abs(div(F.sum("r").over(run).cast("double"), F.sum("r").over(every).cast("double")) - div(F.sum("c").over(run).cast("double"), F.sum("c").over(every).cast("double"))).alias("d"))
    g = cdf.groupBy("indicator_id").agg(F.max("d").alias("ks"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    factor = F.sqrt(-0.5 * F.ln(F.lit(alpha / 2)))
    critical = factor * F.sqrt(div((F.col("nr") + F.col("nc")).cast("double"), (F.col("nr") * F.col("nc")).cast("double")))
    return g.select("indicator_id", "ks", critical.alias("critical"), (F.col("ks") > critical).alias("shifted"))


def safety_flag(checks: DataFrame) -> DataFrame:
    """(indicator_id, check, severity) -> unsafe with any critical, questionable with two warnings, else safe."""
    g = checks.groupBy("indicator_id").agg(F.sum((F.col("severity") == "critical").cast("int")).alias("n_critical"), F.sum((F.col("severity") == "warning").cast("int")).alias("n_warning"))
    return g.withColumn("flag", F.when(F.col("n_critical") > 0, "unsafe").when(F.col("n_warning") >= 2, "questionable").otherwise("safe"))


def worst_flag(flags: DataFrame) -> DataFrame:
    level = F.when(F.col("flag") == "unsafe", 2).when(F.col("flag") == "questionable", 1).otherwise(0)
    return flags.agg(F.max(level).alias("l")).select(F.element_at(F.array(F.lit("safe"), F.lit("questionable"), F.lit("unsafe")), F.col("l") + 1).alias("flag"))


# ---- Q2, Q3: geometry arbitration and window suitability


def arbitrate(views: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(indicator_id, view, geometry, confidence) -> dominant geometry by weighted votes, its share and the disagreement."""
    table = weights or {"LEVEL": 0.30, "RETURNS": 0.35, "VOLATILITY": 0.25, "DEVIATION": 0.30}
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper("view")), F.lit(0.2))
    votes = views.withColumn("vote", w * F.col("confidence")).groupBy("indicator_id", "geometry").agg(F.sum("vote").alias("vote"))
    every = Window.partitionBy("indicator_id")
    ranked = votes.withColumn("share", div(F.col("vote"), F.sum("vote").over(every))).withColumn("place", F.row_number().over(every.orderBy(F.desc("vote"), "geometry")))
    return ranked.where("place = 1").select("indicator_id", F.col("geometry").alias("dominant_geometry"), F.col("share").alias("consensus"), (1 - F.col("share")).alias("disagreement"))


def signature_confidence(scores: list[str], noise: str = "pure_noise") -> tuple[Column, Column]:
    """Confidence .7 max + .3 (top - second), .2 where noise >= .6; hybrid if two other scores reach .5."""
    ordered = F.sort_array(F.array(*scores), asc=False)
    confidence = F.when(F.col(noise) >= 0.6, 0.2).otherwise(0.7 * F.get(ordered, F.lit(0)) + 0.3 * (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))))
    hybrid = reduce(lambda a, b: a + b, [(F.col(s) >= 0.5).cast("int") for s in scores if s != noise]) >= 2
    return confidence, hybrid


def suitability(windows: DataFrame, policy: dict | None = None) -> DataFrame:
    """Status eligible, conditional or ineligible and the allowed engines of each (indicator, window)."""
    p = {**SUITABILITY, **(policy or {})}
    short = F.col("window_years") < p["short_window_threshold"]
    confidence = F.when(short, p["min_confidence"] + p["short_window_confidence_adj"]).otherwise(p["min_confidence"])
    stability = F.when(short, p["short_window_stability_min"]).otherwise(p["min_stability"])
    out = (F.col("n_observations") < p["min_observations"]) | ((F.col("dominant_geometry") == "pure_noise") & (F.col("geometry_pct") > p["pure_noise_threshold"]))
    doubts = {
        "low_quality": F.col("quality_score") < p["min_quality_score"], "low_confidence": F.col("avg_confidence") < confidence, "high_disagreement": F.col("avg_disagreement") > p["max_disagreement"], "low_stability": F.col("stability") < stability,
        "over_smoothing": (F.col("window_years") >= p["long_window_threshold"]) & (F.col("geometry_pct") > p["long_window_max_geometry_pct"]),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in doubts.items()]))
    status = F.when(out, "ineligible").when(F.size(reasons) > 0, "conditional").otherwise("eligible")
    engines = _array(UNIVERSAL)
    for g, names in GEOMETRY_ENGINES.items():
        engines = F.when(F.col("dominant_geometry") == g, _array(sorted({*UNIVERSAL, *names}))).otherwise(engines)
    return windows.withColumn("status", status).withColumn("reasons", F.when(out, _array([])).otherwise(reasons)).withColumn("allowed_engines", F.when(out, _array(NOISE_ALLOWED)).otherwise(F.array_sort(engines)))


def geometry_scan(views: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(indicator_id, window_id, geometry, confidence): the geometry of each window, whether it changed from the one before, and the share of changes."""
    line, every = Window.partitionBy("indicator_id").orderBy("window_id"), Window.partitionBy("indicator_id")
    rows = views.withColumn("before", F.lag("geometry").over(line)).withColumn("changed", F.coalesce(F.col("geometry") != F.col("before"), F.lit(False)))
    rows = rows.withColumn("transition", F.when(F.col("changed"), F.concat_ws(" -> ", "before", "geometry")))
    return rows.withColumn("transition_rate", div(F.sum(F.col("changed").cast("double")).over(every), F.nullif((F.count("*").over(every) - 1).cast("double"), F.lit(0.0)))).drop("before")


def quality_score(scan: DataFrame) -> DataFrame:
    """Window quality .40 confidence + .30 (1 - disagreement) + .20 stability + .10 coverage; the best window of each indicator."""
    s = scan.withColumn("quality_score", 0.40 * F.col("avg_confidence") + 0.30 * (1 - F.col("avg_disagreement")) + 0.20 * F.col("stability") + 0.10 * F.col("coverage"))
    return s.withColumn("optimal", F.row_number().over(Window.partitionBy("indicator_id").orderBy(F.desc("quality_score"), "window_years")) == 1)


# ---- Q5, Q6: engine gates and routing


def gate_table(spark) -> DataFrame:
    """engine, status, min_window, requires_null: a fixed small table."""
    rows = [(e, s, MIN_WINDOW.get(e), e in REQUIRES_NULL) for s, names in STATUS.items() for e in names]
    return spark.createDataFrame(rows, "engine string, gate string, min_window int, requires_null boolean")


def route(requests: DataFrame, domain: str = "all") -> DataFrame:
    """(window_id, n_obs, latent_flow, oscillator, reflexive, null_passed) -> a row an engine: whether it runs, why not, domain fit, weight.

    Excluded engines never run, diagnostic ones run with weight 0; weights are
    shared among those that run and capped, the excess going to the others.
    """
    gates = F.broadcast(gate_table(requests.sparkSession))
    fit = {e: t.get(domain, t.get("all", 0.0 if domain != "all" else max(t.values()))) for e, t in DOMAIN_FIT.items()}
    fits = F.coalesce(F.element_at(F.create_map(*[x for e, v in fit.items() for x in (F.lit(e), F.lit(float(v)))]), F.col("engine")), F.lit(0.0))
    aligned = F.lit(True)
    for e, options in ALIGNMENT.items():
        aligned = F.when(F.col("engine") == e, reduce(lambda a, b: a | b, [F.col(g) >= s for g, s in options])).otherwise(aligned)
    rows = requests.crossJoin(gates).withColumn("domain_fit", fits)  # the gate table has a fixed 17 rows
    reason = (
        F.when(F.col("gate") == "excluded", "excluded").when(F.col("n_obs") < F.col("min_window"), "window_too_short").when(F.col("domain_fit") <= 0, "domain").when(~aligned, "geometry")
        .when(F.col("requires_null") & ~F.coalesce("null_passed", F.lit(False)), "null_not_passed")
    )
    rows = rows.withColumn("reason", reason).withColumn("runs", F.col("reason").isNull())
    raw = F.when(F.col("runs") & (F.col("gate") != "diagnostic"), F.col("domain_fit") * F.when(F.col("gate") == "core", 1.0).otherwise(0.7)).otherwise(0.0)
    every = Window.partitionBy("window_id")
    rows = rows.withColumn("raw", raw).withColumn("share", F.coalesce(div(F.col("raw"), F.sum("raw").over(every)), F.lit(0.0)))
    rows = rows.withColumn("capped", F.least("share", F.lit(WEIGHT_CAP))).withColumn("room", F.when(F.col("share") < WEIGHT_CAP, F.col("share")).otherwise(0.0))
    spare = F.sum("share").over(every) - F.sum("capped").over(every)
    weight = F.least(F.col("capped") + spare * F.coalesce(div(F.col("room"), F.sum("room").over(every)), F.lit(0.0)), F.lit(WEIGHT_CAP))
    return rows.withColumn("weight", weight).drop("raw", "share", "capped", "room")


def contribution_weight(rows: DataFrame) -> DataFrame:
    """gate * null * stability * benchmark * fit, capped."""
    w = F.when(F.col("gate_pass"), 1.0).otherwise(0.0) * F.when(F.col("null_pass"), 1.0).otherwise(0.25) * F.col("stability") * F.col("benchmark_score") * F.col("domain_fit")
    return rows.withColumn("weight", F.least(w, F.lit(WEIGHT_CAP)))


def metric_sensitivity(rows: DataFrame) -> DataFrame:
    """(indicator_id, engine, base, varied): exp(-2 d) with d the mean relative change of a metric under variation; sensitive below .5."""
    d = F.avg(F.abs(F.col("varied") - F.col("base")) / (F.abs("base") + 1e-10))
    return rows.groupBy("indicator_id", "engine").agg(F.exp(-2 * d).alias("stability"), F.count("*").alias("n")).withColumn("sensitive", F.col("stability") < 0.5)


def contradictions(scores: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(indicator_id, engine, score): pairs of engines that should not both be high (above .6)."""
    table = F.broadcast(scores.sparkSession.createDataFrame(list(pairs), "engine_1 string, engine_2 string"))  # the given pairs
    a = scores.select("indicator_id", F.col("engine").alias("engine_1"), F.col("score").alias("x"))
    b = scores.select("indicator_id", F.col("engine").alias("engine_2"), F.col("score").alias("y"))
    return a.join(table, "engine_1").join(b, ["indicator_id", "engine_2"]).where("x > 0.6 AND y > 0.6").select("indicator_id", "engine_1", "engine_2", "x", "y")


def residual_checks(residuals: DataFrame, keys=("indicator_id",), limit: float = 0.3) -> DataFrame:
    """(indicator_id, date, value): lag-1 autocorrelation of residuals; above the limit there is structure left."""
    line = Window.partitionBy(*keys).orderBy("date")
    rows = residuals.withColumn("b", F.lag("value").over(line))
    g = rows.groupBy(*keys).agg(safe_corr(F.col("value"), F.col("b")).alias("residual_acf1"))
    return g.withColumn("structured", F.coalesce(F.abs("residual_acf1") > limit, F.lit(False)))


def escalations(findings: DataFrame) -> DataFrame:
    """(indicator_id, kind) of blind spots -> number, kinds and level: none, watch, review (2), escalate (3 or more)."""
    g = findings.groupBy("indicator_id").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    n = F.col("n_findings")
    return g.withColumn("level", F.when(n >= 3, "escalate").when(n == 2, "review").otherwise("watch"))


# ---- Q10, Q11, Q12: contribution, exclusion, allow lists


def contribution(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score of clamped metrics (missing ones count .5), failure ratio and a hint."""
    w = weights or CONTRIBUTION_WEIGHTS
    total = sum(w.values())
    ics = reduce(lambda a, b: a + b, [clip(F.coalesce(F.col(k), F.lit(0.5)), 0.0, 1.0) * F.lit(v / total) for k, v in w.items()])
    out = metrics.withColumn("ics", ics).withColumn("failure_ratio", 1 - F.col("ics"))
    return out.withColumn("hint", F.when(F.col("failure_ratio") > 0.6, "exclude_candidate").when(F.col("failure_ratio") > 0.4, "review").otherwise("keep"))


def apply_exclusion(contributions: DataFrame, mode: str = "exclude", threshold: float = 0.6, min_indicators: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """active per indicator.  Where too few would stay, those with the least failure ratio are restored."""
    bad = F.col("failure_ratio") > threshold
    out = contributions.withColumn("would_exclude", bad)
    if mode != "exclude":
        return out.withColumn("active", F.lit(True))
    order = Window.partitionBy(*keys).orderBy(F.col("would_exclude").cast("int"), "failure_ratio", "indicator_id")
    return out.withColumn("active", ~F.col("would_exclude") | (F.row_number().over(order) <= min_indicators))


def allowed(panel: DataFrame, allowlist: DataFrame) -> DataFrame:
    return panel.join(allowlist.select("indicator_id").distinct(), "indicator_id", "left_semi")


# ---- Q8, Q9, Q13, Q14: stability, blind spots, validation


def redundancy(scores: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Engine pairs whose scores correlate at least so much."""
    a = scores.select("indicator_id", F.col("engine").alias("engine_1"), F.col("score").alias("x"))
    b = scores.select("indicator_id", F.col("engine").alias("engine_2"), F.col("score").alias("y"))
    c = a.join(b, "indicator_id").where("engine_1 < engine_2").groupBy("engine_1", "engine_2").agg(safe_corr(F.col("x"), F.col("y")).alias("corr"))
    return c.where(F.abs("corr") >= threshold)


def leave_one_out(contributions: DataFrame, critical: float = 0.2) -> DataFrame:
    """(window_id, engine, weight, value): shift of the weighted mean when an engine is left out."""
    every = Window.partitionBy("window_id")
    sw, swv = F.sum("weight").over(every), F.sum(F.col("weight") * F.col("value")).over(every)
    mean, without = div(swv, sw), div(swv - F.col("weight") * F.col("value"), F.nullif(sw - F.col("weight"), F.lit(0.0)))
    out = contributions.withColumn("shift", F.abs(without - mean))
    return out.withColumn("critical", F.coalesce(F.col("shift") > critical, F.lit(False)))


#: Descriptors that a geometry class should show, with the least value.  Fixed values.
EXPECTED = {"latent_flow": [("trend_r_squared", 0.3)], "coupled_oscillator": [("periodicity", 0.3)], "reflexive_stochastic": [("volatility_clustering", 0.2)]}


def missing_features(classes: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Expected descriptors that a classified indicator lacks or has too little of."""
    rules = [(g, d, v) for g, items in EXPECTED.items() for d, v in items]
    table = F.broadcast(classes.sparkSession.createDataFrame(rules, "dominant_geometry string, dimension string, least double"))
    want = classes.join(table, "dominant_geometry")
    got = want.join(descriptors.select("indicator_id", "dimension", "value"), ["indicator_id", "dimension"], "left")
    return got.where(F.col("value").isNull() | (F.col("value") < F.col("least"))).select("indicator_id", "dominant_geometry", "dimension", "value", "least")


def validate_outputs(outputs: DataFrame) -> DataFrame:
    """(engine, window_id, value, n_obs, min_obs): reason codes, penalty and validity score of engine outputs."""
    checks = [("missing", F.col("value").isNull(), 1.0), ("not_finite", F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(False)), 1.0), ("too_few", F.col("n_obs") < F.col("min_obs"), 0.5), ("extreme", F.coalesce(F.abs("value") > 1e6, F.lit(False)), 0.3)]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _ in checks]))
    penalty = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for _, c, w in checks])
    return outputs.withColumn("reasons", reasons).withColumn("validity", F.greatest(F.lit(1.0) - penalty, F.lit(0.0)))


def effective_confidence(validated: DataFrame) -> DataFrame:
    """Counts and mean validity a window, and confidence scaled by it."""
    return validated.groupBy("window_id").agg(F.count("*").alias("n_outputs"), F.sum((F.col("validity") >= 0.8).cast("int")).alias("n_valid"), F.avg("validity").alias("mean_validity"), (F.avg("validity") * F.avg(F.coalesce("confidence", F.lit(1.0)))).alias("effective_confidence"))


def validate_vectors(vectors: DataFrame, n_expected: int = 7) -> DataFrame:
    """Tall (entity, component, value): completeness, NaN share, extremes -> valid, marginal, invalid."""
    bad = F.col("value").isNull() | F.isnan("value")
    g = vectors.groupBy("entity").agg((F.count_distinct("component") / F.lit(n_expected)).alias("completeness"), F.avg(bad.cast("double")).alias("nan_ratio"), F.avg((F.abs("value") > 1e3).cast("double")).alias("extreme_ratio"))
    score = F.col("completeness") * (1 - F.col("nan_ratio")) * (1 - F.coalesce("extreme_ratio", F.lit(0.0)))
    return g.withColumn("score", score).withColumn("status", F.when(score >= 0.8, "valid").when(score >= 0.5, "marginal").otherwise("invalid"))


def component_balance(vectors: DataFrame) -> DataFrame:
    """Share of each component in the magnitude; dominant above .30, negligible below .05."""
    m = vectors.groupBy("entity", "component").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("magnitude"))
    share = div(F.col("magnitude"), F.sum("magnitude").over(Window.partitionBy("entity")))
    return m.withColumn("share", share).withColumn("role", F.when(share > 0.30, "dominant").when(share < 0.05, "negligible").otherwise("balanced"))


def geometry_stability(windows: DataFrame, measures: list[str], keys=("cohort_id",)) -> DataFrame:
    """Mean of 1 / (1 + |change|) of the measures between consecutive windows; stable from .7 on."""
    line = Window.partitionBy(*keys).orderBy("window_id")
    cols = {f"__s_{m}": 1 / (1 + F.abs(F.col(m) - F.lag(m).over(line))) for m in measures}
    out = windows.withColumns(cols)
    score = reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)
    return out.withColumn("stability", score).withColumn("stable", score >= 0.7).drop(*cols)


def relevance(positions: DataFrame) -> DataFrame:
    """Importance .4 centrality + .3 leadership + .3 uniqueness, and a leader or follower role."""
    s = 0.4 * F.col("centrality") + 0.3 * F.col("leadership") + 0.3 * F.col("uniqueness")
    return positions.withColumn("importance", s).withColumn("role", F.when(F.col("leadership") > 0.6, "leader").when(F.col("leadership") < 0.4, "follower").otherwise("neutral"))


def lens_divergence(corr: DataFrame, descriptors: DataFrame, similar: float = 0.70, different: float = 0.30) -> DataFrame:
    """Pairs that move together but differ in structure, or the reverse: cosine of descriptor vectors against |r|."""
    a = descriptors.select(F.col("indicator_id").alias("id_1"), "dimension", F.col("value").alias("x"))
    b = descriptors.select(F.col("indicator_id").alias("id_2"), "dimension", F.col("value").alias("y"))
    cos = a.join(b, "dimension").where("id_1 < id_2").groupBy("id_1", "id_2").agg(div(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("structure"))
    out = corr.join(cos, ["id_1", "id_2"])
    kind = F.when((F.abs("corr") > similar) & (F.col("structure") < similar), "moves_together_differs").when((F.abs("corr") < different) & (F.col("structure") > similar), "hidden_similarity").otherwise("consistent")
    return out.withColumn("kind", kind)
