"""Geometry dynamics: distance to a home region, trajectories, excursions, attribution, state vectors.

A distance series is (entity, date, distance); native window expressions do
the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import div, euclid, logistic, quadratic
from geoloom.operators.rolling import islands

ENTITY = ("entity",)


def _line(keys=ENTITY):
    return Window.partitionBy(*keys).orderBy("date")


# ---- home region


def distance_to(points: DataFrame, centre: list[float], precision: list[list[float]], radius: float, vector: str = "vector") -> DataFrame:
    """Mahalanobis distance, whether inside, and the percentile among all points."""
    d = F.transform(F.col(vector), lambda x, i: x.cast("double") - F.get(F.array(*[F.lit(float(c)) for c in centre]), i))
    out = points.withColumn("distance", F.sqrt(F.greatest(quadratic(d, precision), F.lit(0.0)))).withColumn("inside", F.col("distance") <= radius)
    keys = [c for c in ENTITY if c in points.columns]
    if keys:
        return out.withColumn("percentile", F.cume_dist().over(Window.partitionBy(*keys).orderBy("distance")))
    return share_at_most(out, "distance").withColumnRenamed("share", "percentile")


def share_at_most(rows: DataFrame, value: str, cuts: int = 256) -> DataFrame:
    """Adds share, the exact share of rows whose value is at most the row's, over the whole table.

    Rows are ranged by approximate quantiles; a row a range carries the rows
    before it, and ranks are taken within ranges, so no task sorts the table.
    """
    edges = rows.select(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 10_000).alias("e")).first()["e"] or []
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e < F.col(value))) if edges else F.lit(0)
    ranged = rows.withColumn("__range", at)
    counts = ranged.groupBy("__range").agg(F.count(value).alias("__c"))  # a row a range
    order = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__c").over(order), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    joined = ranged.join(F.broadcast(counts), F.col("__range") == F.col("__r"))  # at most ``cuts`` rows
    upto = F.count(value).over(Window.partitionBy("__range").orderBy(value))
    return joined.withColumn("share", div((F.col("__before") + upto).cast("double"), F.col("__n").cast("double"))).drop("__range", "__r", "__before", "__n")


# ---- trajectories


def trajectory_state(series: DataFrame, radius: float, noise: float = 0.05, keys=ENTITY) -> DataFrame:
    """Velocity, acceleration and state: inside, reverting, escalating or stalling."""
    line = _line(keys)
    v = F.col("distance") - F.lag("distance").over(line)
    out = series.withColumn("velocity", v).withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(line))
    state = F.when(F.col("distance") <= radius, "inside").when(F.col("velocity") < -noise, "reverting").when(F.col("velocity") > noise, "escalating").otherwise("stalling")
    return out.withColumn("state", state)


def mean_reversion(series: DataFrame, radius: float, keys=ENTITY) -> DataFrame:
    """dD = alpha + beta (D - r): coefficients, R2 and half-life."""
    line = _line(keys)
    rows = series.withColumn("d", F.lead("distance").over(line) - F.col("distance")).withColumn("x", F.col("distance") - F.lit(radius)).where(F.col("d").isNotNull())
    beta = div(F.covar_pop("x", "d"), F.var_pop("x"))
    g = rows.groupBy(*keys).agg(beta.alias("beta"), (F.avg("d") - beta * F.avg("x")).alias("alpha"), div(F.covar_pop("x", "d") * F.covar_pop("x", "d"), F.var_pop("x") * F.var_pop("d")).alias("r_squared"), F.count("*").alias("n"))
    return g.withColumn("half_life", F.when((F.col("beta") < 0) & (F.col("beta") > -1), -F.ln(F.lit(2.0)) / F.log1p("beta")))


def hazards(series: DataFrame, radius: float, horizons: tuple[int, ...] = (20, 60), band: float = 0.2, keys=ENTITY) -> DataFrame:
    """Chances of re-entry and of escalation within each horizon, over past days like the last one: distance within +-band, velocity of the same sign."""
    line = _line(keys)
    rows = series.withColumn("v", F.col("distance") - F.lag("distance").over(line))
    ahead = {}
    for h in horizons:
        w = line.rowsBetween(1, h)
        ahead[f"low_{h}"], ahead[f"high_{h}"], ahead[f"n_{h}"] = F.min("distance").over(w), F.max("distance").over(w), F.count("distance").over(w)
    rows = rows.withColumns(ahead)
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("now", F.max_by("distance", "date").over(every)).withColumn("now_v", F.max_by("v", "date").over(every))
    like = (F.abs(F.col("distance") - F.col("now")) <= F.lit(band) * F.col("now")) & (F.signum("v") == F.signum("now_v"))
    aggs = []
    for h in horizons:
        full = F.when(F.col(f"n_{h}") == h, True)
        aggs += [F.avg(F.when(full, (F.col(f"low_{h}") <= radius).cast("double"))).alias(f"p_reentry_{h}"), F.avg(F.when(full, (F.col(f"high_{h}") > F.col("distance") * (1 + band)).cast("double"))).alias(f"p_escalate_{h}"), F.count(full).alias(f"n_similar_{h}")]
    return rows.where(like).groupBy(*keys).agg(*aggs)


def pull_strength(series: DataFrame, radius: float, keys=ENTITY) -> DataFrame:
    """Mean inward speed per unit of excess while outside and coming back, and its half-life."""
    line = _line(keys)
    rows = series.withColumn("v", F.lead("distance").over(line) - F.col("distance")).where((F.col("distance") > radius) & (F.col("v") < 0))
    g = rows.groupBy(*keys).agg(F.avg(div(-F.col("v"), F.col("distance") - F.lit(radius))).alias("pull"), F.count("*").alias("n"))
    return g.withColumn("half_life", F.when(F.col("pull") > 0, F.ln(F.lit(2.0)) / F.col("pull")))


# ---- excursions


def excursions(series: DataFrame, radius: float, keys=ENTITY) -> DataFrame:
    """One row a stay outside: first, last, days, peak and mean distance; open if it reaches the end."""
    rows = islands(series.withColumn("outside", F.col("distance") > radius), "outside", keys)
    end = F.max("date").over(Window.partitionBy(*keys))
    g = rows.withColumn("end", end).where("outside").groupBy(*keys, "run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"), F.max("distance").alias("peak"), F.avg("distance").alias("mean_distance"), F.max("end").alias("end"))
    return g.withColumn("open", F.col("last") == F.col("end")).drop("run", "end")


def excursion_summary(series: DataFrame, radius: float, baseline_churn: float | None = None, keys=ENTITY) -> DataFrame:
    """Share outside, crossings, episodes, longest and mean stay, churn (mean |change|)."""
    line = _line(keys)
    rows = series.withColumn("outside", (F.col("distance") > radius).cast("int"))
    rows = rows.withColumn("crossed", (F.col("outside") != F.lag("outside").over(line)).cast("int")).withColumn("step", F.abs(F.col("distance") - F.lag("distance").over(line)))
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("outside").cast("double")).alias("excursion_rate"), F.coalesce(F.sum("crossed"), F.lit(0)).alias("crossings"), F.avg("step").alias("churn"))
    e = excursions(series, radius, keys).groupBy(*keys).agg(F.count("*").alias("episodes"), F.max("days").alias("longest"), F.avg("days").alias("mean_days"), F.max("peak").alias("peak"))
    out = a.join(e, list(keys), "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    return out if baseline_churn is None else out.withColumn("churn_ratio", div(F.col("churn"), F.lit(baseline_churn)))


# ---- attribution


def conditional_attribution(condition: DataFrame, indicators: DataFrame, horizon: int = 20, min_episodes: int = 5) -> DataFrame:
    """(date, flag) and a panel: mean change of each indicator over ``horizon`` rows after the flag rises, over its deviation; ranked by size."""
    onset = condition.withColumn("before", F.lag("flag").over(Window.orderBy("date"))).where(F.col("flag") & ~F.coalesce("before", F.lit(False))).select("date")
    line = Window.partitionBy("indicator_id").orderBy("date")
    moved = indicators.withColumn("change", F.lead("value", horizon).over(line) - F.col("value"))
    g = moved.join(onset, "date", "left_semi").where(F.col("change").isNotNull()).groupBy("indicator_id").agg(F.count("*").alias("n_episodes"), F.avg("change").alias("mean_change"), F.stddev_pop("change").alias("std_change"))
    g = g.where(F.col("n_episodes") >= min_episodes).withColumn("effect", div(F.col("mean_change"), F.nullif(F.col("std_change"), F.lit(0.0))))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("effect")), "indicator_id")))


def attribution_intervals(condition: DataFrame, indicators: DataFrame, horizon: int = 20, min_episodes: int = 5, n_boot: int = 100, run: str = "run") -> DataFrame:
    """Effect of each indicator after the flag rises, with a 95 % interval by resampling its episodes; ``certain`` if it leaves out zero."""
    import numpy as np

    from geoloom.kernels.series import effect_ci
    from geoloom.operators.grouped import arrow_groups, seed_of

    onset = condition.withColumn("before", F.lag("flag").over(Window.orderBy("date"))).where(F.col("flag") & ~F.coalesce("before", F.lit(False))).select("date")
    line = Window.partitionBy("indicator_id").orderBy("date")
    moved = indicators.withColumn("change", F.lead("value", horizon).over(line) - F.col("value")).join(onset, "date", "left_semi").where(F.col("change").isNotNull())

    def boot(key, table):
        v = table.sort_by("date")["change"].to_numpy()
        if len(v) < min_episodes:
            return []
        got = effect_ci(v, np.random.default_rng(seed_of(run, *key)), n_boot)
        return [(len(v), got["effect"], got["effect_low"], got["effect_high"], bool(got["certain"]))]

    return arrow_groups(moved.select("indicator_id", "date", "change"), ("indicator_id",), "n_episodes long, effect double, effect_low double, effect_high double, certain boolean", boot)


def indicator_lead(condition: DataFrame, indicators: DataFrame, window: int = 10) -> DataFrame:
    """Mean move in the ``window`` rows before the flag rises, over the mean absolute move."""
    onset = condition.withColumn("before", F.lag("flag").over(Window.orderBy("date"))).where(F.col("flag") & ~F.coalesce("before", F.lit(False))).select(F.col("date").alias("onset"))
    line = Window.partitionBy("indicator_id").orderBy("date")
    moved = indicators.withColumn("run_up", F.col("value") - F.lag("value", window).over(line)).withColumn("usual", F.avg(F.abs("run_up")).over(Window.partitionBy("indicator_id")))
    return moved.join(onset, F.col("date") == F.col("onset"), "left_semi").groupBy("indicator_id").agg(F.avg("run_up").alias("mean_run_up"), div(F.avg("run_up"), F.max("usual")).alias("lead_score"), F.count("run_up").alias("n"))


# ---- state vectors


#: Dimension -> component of the state vector.  Fixed values: G geometry, M memory, C complexity, P periodicity, T trend, S stability, R risk.
COMPONENTS = {
    "saturation": "G", "asymmetry": "G", "bounded_accumulation": "G", "hurst": "M", "hurst_dfa": "M", "mean_abs_acf": "M", "shannon_entropy": "C", "permutation_entropy": "C", "sample_entropy": "C", "dominant_frequency": "P", "spectral_flatness": "P",
    "trend_slope": "T", "trend_r_squared": "T", "variance_ratio": "S", "rolling_mean_stability": "S", "half_life": "S", "realized_volatility": "R", "max_drawdown": "R", "downside_volatility": "R",
}


def assemble_vectors(descriptors: DataFrame, keys=("indicator_id", "window_id")) -> DataFrame:
    """Tall descriptors -> component -> {dimension: value}, and how many of the components are there."""
    table = F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv])
    rows = descriptors.withColumn("component", F.element_at(table, F.col("dimension"))).where(F.col("component").isNotNull())
    parts = rows.groupBy(*keys, "component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "value")))).alias("dims"))
    out = parts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", F.map_entries("dims").alias("e"))), lambda a, b: F.when(a["component"] < b["component"], -1).when(a["component"] > b["component"], 1).otherwise(0))).alias("entries"), F.count("*").alias("n_components"))
    return out.withColumn("completeness", F.col("n_components") / F.lit(len(set(COMPONENTS.values()))))


def vector_motion(descriptors: DataFrame, keys=("indicator_id",), threshold: float = 2.0) -> DataFrame:
    """Distance between consecutive windows over shared dimensions, its z-score, resistance exp(-mean) and anomalies."""
    line = Window.partitionBy(*keys, "dimension").orderBy("window_id")
    step = descriptors.withColumn("d", F.col("value") - F.lag("value").over(line)).where(F.col("d").isNotNull())
    moved = step.groupBy(*keys, "window_id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("distance"), F.count("*").alias("n_dims"))
    every = Window.partitionBy(*keys)
    z = div(F.col("distance") - F.avg("distance").over(every), F.nullif(F.stddev_pop("distance").over(every), F.lit(0.0)))
    return moved.withColumn("z", z).withColumn("anomalous", F.coalesce(F.abs("z") > threshold, F.lit(False))).withColumn("resistance", F.exp(-F.avg("distance").over(every)))


def array_motion(vectors: DataFrame, keys, order: str, vector: str = "vector") -> DataFrame:
    """Step length between consecutive arrays."""
    line = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(vector).over(line)
    return vectors.withColumn("before", before).withColumn("step", F.when(F.col("before").isNotNull(), euclid(F.col(vector), F.col("before")))).drop("before")


def hidden_mass(descriptors: DataFrame, cohort_keys=("cohort_id", "window_id"), z_limit: float = 2.0) -> DataFrame:
    """Members of a cohort far from its centroid: distance and z among the members.

    Squares are added by size, not as they arrive: two members lie equally far from their centroid, and a last digit
    that hangs on the order of a shuffle would give them a deviation, hence a z.
    """
    every = Window.partitionBy(*cohort_keys, "dimension")
    d = descriptors.withColumn("d", F.col("value") - F.avg("value").over(every))
    squares = d.groupBy(*cohort_keys, "indicator_id").agg(F.array_sort(F.collect_list(F.col("d") * F.col("d"))).alias("s"))
    total = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    far = squares.select(*cohort_keys, "indicator_id", F.sqrt(total).alias("distance"))
    w = Window.partitionBy(*cohort_keys)
    z = div(F.col("distance") - F.avg("distance").over(w), F.nullif(F.stddev_pop("distance").over(w), F.lit(0.0)))
    return far.withColumn("z", z).withColumn("hidden_mass", F.coalesce(F.col("z") > z_limit, F.lit(False)))


def snapshots(motion: DataFrame, keys=("indicator_id",), smooth: int = 5) -> DataFrame:
    """Speed, acceleration, momentum and behaviour class: steady, drifting, accelerating, decelerating, jumping."""
    line = Window.partitionBy(*keys).orderBy("window_id")
    every = Window.partitionBy(*keys)
    rows = motion.withColumn("speed", F.col("distance")).withColumn("acceleration", F.col("distance") - F.lag("distance").over(line)).withColumn("momentum", F.avg("distance").over(line.rowsBetween(-(smooth - 1), 0)))
    sd, mean = F.stddev_pop("distance").over(every), F.avg("distance").over(every)
    kind = F.when(F.col("speed") > mean + 2 * sd, "jumping").when(F.abs("acceleration") <= 0.1 * mean, F.when(F.col("speed") < 0.5 * mean, "steady").otherwise("drifting")).when(F.col("acceleration") > 0, "accelerating").when(F.col("acceleration") < 0, "decelerating").otherwise("steady")
    return rows.withColumn("behaviour", kind)


def interpretation(frames: DataFrame, keys=("window_id",)) -> DataFrame:
    """Per window over members (tension, velocity): mean tension, entropy of its shares, Gini, logistic rupture risk."""
    w = Window.partitionBy(*keys)
    share = div(F.col("tension"), F.sum("tension").over(w))
    rows = frames.withColumn("p", share).withColumn("rank", F.row_number().over(w.orderBy("tension", "indicator_id"))).withColumn("n", F.count("*").over(w))
    g = rows.groupBy(*keys).agg(F.avg("tension").alias("mean_tension"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")))).alias("entropy"), F.max("n").alias("n"), F.sum(F.col("rank") * F.col("tension")).alias("rt"), F.sum("tension").alias("t"), F.avg(F.abs("velocity")).alias("speed"))
    n = F.col("n").cast("double")
    gini = div(2 * F.col("rt"), n * F.col("t")) - (n + 1) / n
    return g.select(*keys, "mean_tension", "entropy", div(F.col("entropy"), F.nullif(F.ln(n), F.lit(0.0))).alias("relative_entropy"), gini.alias("gini"), logistic(4 * (F.col("mean_tension") + F.col("speed") + gini - 1)).alias("rupture_risk"))


def persistence(motion: DataFrame, keys=("indicator_id",)) -> DataFrame:
    """Transitions (steps above mean + 1.5 deviations), their rate, smoothness, and the weighted persistence score .4/.3/.3."""
    every = Window.partitionBy(*keys)
    rows = motion.where(F.col("step").isNotNull()).withColumn("jump", F.col("step") > F.avg("step").over(every) + 1.5 * F.stddev_pop("step").over(every))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.avg("step").alias("mean_step"), F.stddev_pop("step").alias("std_step"), F.max("step").alias("max_step"), F.sum(F.col("jump").cast("int")).alias("transitions"))
    rate = F.col("transitions") / F.col("n_steps")
    smooth = F.lit(1.0) / (F.lit(1.0) + F.coalesce(div(F.col("std_step"), F.nullif(F.col("mean_step"), F.lit(0.0))), F.lit(0.0)))
    return g.withColumn("transition_rate", rate).withColumn("smoothness", smooth).withColumn("persistence", 0.4 * (1 - rate) + 0.3 * smooth + 0.3 * div(F.col("mean_step"), F.nullif(F.col("max_step"), F.lit(0.0))))


def agreement(scores: DataFrame, keys=("window_id",), threshold: float = 0.3) -> DataFrame:
    """Pairs of engines that agree, disagree or are unrelated by correlation of their scores over indicators; counts a window."""
    from geoloom.functions.mathx import safe_corr

    a = scores.select(*keys, "indicator_id", F.col("engine").alias("engine_1"), F.col("score").alias("x"))
    b = scores.select(*keys, "indicator_id", F.col("engine").alias("engine_2"), F.col("score").alias("y"))
    c = a.join(b, [*keys, "indicator_id"]).where("engine_1 < engine_2").groupBy(*keys, "engine_1", "engine_2").agg(safe_corr(F.col("x"), F.col("y")).alias("corr"))
    return c.withColumn("relation", F.when(F.col("corr") >= threshold, "agree").when(F.col("corr") <= -threshold, "contradict").when(F.col("corr").isNotNull(), "unrelated"))


FORBIDDEN = ("regime", "predict", "forecast", "signal", "buy", "sell")


def semantic_guard(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """Rows whose text columns hold a forbidden token as a word."""
    pattern = r"(?i)\b(" + "|".join(tokens) + r")\b"
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(hit)
