"""State vectors: motion, coherence, resistance, deformation, hidden mass, residual physics, assembly and validation.

A vector is an array of doubles per (entity, window_id), or one row a
dimension where that is said.  Matrices are small and go out as literals, so
everything is window and aggregate expressions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.mathx import EPS, clip, div, dot, norm, quadratic, safe_corr, zip_sum
from geoloom.operators.rolling import islands

ENTITY = ("entity",)
#: Plausible resistance by domain, and the percentile classes.
RESISTANCE_BOUNDS = {"finance": (0.2, 0.9), "climate": (0.6, 0.95), "epidemiology": (0.1, 0.8), "default": (0.1, 0.95)}
RESISTANCE_CLASSES = ((0.9, "very_rigid"), (0.7, "rigid"), (0.3, "moderate"), (0.1, "fluid"))
#: Engine output, key and transform of each dimension of an assembled vector.
FRAME = (
    ("pca", "pc1_loading", None), ("pca", "pc2_loading", None), ("pca", "explained_variance_1", None), ("hmm", "state_entropy", None), ("hmm", "transition_rate", None), ("correlation", "mean_correlation", None),
    ("correlation", "correlation_std", None), ("hurst", "hurst_exponent", None), ("wavelet", "dominant_scale", "log"), ("dmd", "dominant_frequency", None),
)


def _line(keys=ENTITY, order: str = "window_id"):
    return Window.partitionBy(*keys).orderBy(order)


def _status(score: Column, valid: float = 0.8, marginal: float = 0.5) -> Column:
    return F.when(score >= valid, "valid").when(score >= marginal, "marginal").otherwise("invalid")


def _judged(rows: DataFrame, checks: list[tuple[str, Column, float]], start: Column | None = None, valid: float = 0.8, marginal: float = 0.5) -> DataFrame:
    """Adds issues (names of the checks that fail), score (what they leave of ``start``, within 0 and 1) and status."""
    fails = [(k, F.coalesce(c, F.lit(False)), w) for k, c, w in checks]
    left = reduce(lambda a, b: a - b, [F.when(c, w).otherwise(0.0) for _, c, w in fails], start if start is not None else F.lit(1.0))
    out = rows.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _ in fails]))).withColumn("score", F.round(clip(left, 0.0, 1.0), 9))
    return out.withColumn("status", _status(F.col("score"), valid, marginal))


# ---- motion


def velocities(vectors: DataFrame, keys=ENTITY, vector: str = "vector") -> DataFrame:
    """Adds velocity (array; null in the first window) and displacement (its length)."""
    before = F.lag(vector).over(_line(keys))
    moved = vectors.withColumn("__b", before)
    moved = moved.withColumn("velocity", F.when(F.col("__b").isNotNull(), F.zip_with(vector, "__b", lambda x, y: x - y))).drop("__b")
    return moved.withColumn("displacement", norm(F.col("velocity")))


def trajectory_stats(vectors: DataFrame, keys=ENTITY, vector: str = "vector") -> DataFrame:
    """Length of the way, mean and largest step, and the distance from the first window to the last."""
    rows = velocities(vectors, keys, vector)
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("displacement"), F.lit(0.0)).alias("total_distance"), F.coalesce(F.avg("displacement"), F.lit(0.0)).alias("avg_step_size"), F.coalesce(F.max("displacement"), F.lit(0.0)).alias("max_step_size"), F.min_by(vector, "window_id").alias("__a"), F.max_by(vector, "window_id").alias("__z"))
    return g.withColumn("net_displacement", F.sqrt(zip_sum(F.col("__a"), F.col("__z"), lambda x, y: (x - y) * (x - y)))).drop("__a", "__z")


def trajectory_coherence(windows: DataFrame, keys=ENTITY, min_windows: int = 3, limit: float = 3.0, max_sparse: int = 2) -> DataFrame:
    """(entity, window_id, window_start, displacement, completeness): length, order, jumps (z beyond ``limit``), sparse windows -> score, status."""
    line, every = _line(keys), Window.partitionBy(*keys)
    z = div(F.col("displacement") - F.avg("displacement").over(every), F.nullif(F.stddev_pop("displacement").over(every), F.lit(0.0)))
    rows = windows.withColumn("__z", z).withColumn("__back", (F.col("window_start") < F.lag("window_start").over(line)).cast("int"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), (F.coalesce(F.max("__back"), F.lit(0)) == 0).alias("is_chronological"), F.avg("displacement").alias("mean_displacement"), F.stddev_pop("displacement").alias("std_displacement"),
        F.when(F.count("displacement") >= 3, F.sum(F.coalesce(F.abs("__z") > limit, F.lit(False)).cast("int"))).otherwise(0).cast("long").alias("n_discontinuities"), F.sum((F.col("completeness") < 0.3).cast("int")).alias("n_sparse"),
    )
    jumps = F.lit(1.0) - 0.1 * F.col("n_discontinuities")
    return _judged(g, [("too_few_windows", F.col("n_windows") < min_windows, 0.4), ("not_chronological", ~F.col("is_chronological"), 0.3), ("discontinuities", F.col("n_discontinuities") > 0, 0.0), ("sparse_windows", F.col("n_sparse") > max_sparse, 0.15)], jumps)


def resistance_calibration(rows: DataFrame, domain: str = "domain", enough: int = 5) -> DataFrame:
    """(entity, resistance, n_windows, domain): bounds of the domain, confidence, percentile and class within the domain's population (over 5), status."""
    names = F.when(F.col(domain).isin([k for k in RESISTANCE_BOUNDS if k != "default"]), F.col(domain)).otherwise("default")
    low = F.element_at(F.create_map(*[F.lit(x) for k, (a, _) in RESISTANCE_BOUNDS.items() for x in (k, a)]), names)
    high = F.element_at(F.create_map(*[F.lit(x) for k, (_, b) in RESISTANCE_BOUNDS.items() for x in (k, b)]), names)
    out = rows.withColumn("in_bounds", F.col("resistance").between(low, high))
    out = out.withColumn("confidence", F.when(F.col("n_windows") >= enough, 0.9).when(F.col("n_windows") >= 3, 0.6).otherwise(0.3))
    known = F.col("resistance").isNotNull()
    share = F.cume_dist().over(Window.partitionBy(domain, known).orderBy("resistance"))
    share = F.when(known & (F.count("resistance").over(Window.partitionBy(domain)) > 5), share)
    kind = F.lit("very_fluid")
    for least, name in reversed(RESISTANCE_CLASSES):
        kind = F.when(F.col("percentile") > least, name).otherwise(kind)
    out = out.withColumn("percentile", share).withColumn("class", F.when(F.col("percentile").isNotNull(), kind))
    out = _judged(out, [("out_of_bounds", ~F.col("in_bounds"), 0.2), ("few_windows", F.col("n_windows") < 3, 0.0)], F.col("confidence"), 0.7, 0.4)
    return out.withColumn("score", F.when(known, F.col("score")).otherwise(0.0)).withColumn("status", F.when(known, F.col("status")).otherwise("invalid"))


# ---- deformation


def deformation(moved: DataFrame, keys=("window_id",), least: int = 5) -> DataFrame:
    """(window_id, entity, velocity array): mean velocity, dispersion, coherence of directions (length of the mean unit vector) and the kind of field."""
    rows = moved.where(F.col("velocity").isNotNull()).withColumn("__n", norm(F.col("velocity")))
    parts = rows.select(*keys, "entity", F.posexplode("velocity").alias("dim", "v"), "__n").withColumn("u", F.coalesce(div(F.col("v"), F.nullif(F.col("__n"), F.lit(0.0))), F.lit(0.0)))
    parts = parts.withColumn("m", F.avg("v").over(Window.partitionBy(*keys, "dim")))
    off = parts.groupBy(*keys, "entity").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("off")).groupBy(*keys).agg(F.avg("off").alias("velocity_dispersion"), F.count("*").alias("n_indicators"))
    per = parts.groupBy(*keys, "dim").agg(F.avg("v").alias("m"), F.avg("u").alias("u")).groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_velocity"), F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("coherence"))
    kind = F.when(F.col("coherence") > 0.7, "coherent_drift").when(F.col("coherence") < 0.3, "dispersive").otherwise("mixed")
    return per.join(off, list(keys)).where(F.col("n_indicators") >= least).withColumn("kind", kind)


def deformation_outliers(moved: DataFrame, keys=("window_id",), limit: float = 2.0) -> DataFrame:
    """Entities whose displacement in a window lies over ``limit`` deviations from the others': fast movers and anchored ones."""
    every = Window.partitionBy(*keys)
    rows = moved.where(F.col("displacement").isNotNull())
    z = div(F.col("displacement") - F.avg("displacement").over(every), F.nullif(F.stddev_pop("displacement").over(every), F.lit(0.0)))
    return rows.withColumn("z", z).where(F.abs("z") > limit).select(*keys, "entity", "displacement", "z", F.when(F.col("z") > 0, "fast_mover").otherwise("anchored").alias("kind"))


def stress_regions(moved: DataFrame, keys=ENTITY) -> DataFrame:
    """Entities (three moves at least) whose displacement varies by more than twice its mean."""
    g = moved.groupBy(*keys).agg(F.count("displacement").alias("n"), F.var_pop("displacement").alias("variance"), F.avg("displacement").alias("mean"))
    return g.where((F.col("n") >= 3) & (F.col("variance") > 2 * F.col("mean")))


def attribute_anomalies(anomalies: DataFrame, events: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(entity, window_id, z): candidate explanations of each anomaly by confidence: events of the window, a systematic factor (3 peers or more), an idiosyncratic one (none), an extreme event (z above 3)."""
    rows = anomalies.withColumn("n_peers", F.count("*").over(Window.partitionBy("window_id")) - 1)
    peers = F.col("n_peers")
    candidates = F.array_compact(
        F.array(
            F.when(peers >= 3, F.struct(F.lit("systematic_factor").alias("candidate"), F.least(F.lit(0.8), 0.3 + 0.1 * peers).alias("confidence"))),
            F.when(peers == 0, F.struct(F.lit("idiosyncratic_factor").alias("candidate"), F.lit(0.4).alias("confidence"))),
            F.when(F.col("z") > 3, F.struct(F.lit("extreme_event").alias("candidate"), F.lit(0.6).alias("confidence"))),
        )
    )
    found = rows.select("entity", "window_id", "n_peers", F.explode(candidates).alias("c")).select("entity", "window_id", "n_peers", "c.candidate", "c.confidence")
    if events is not None:
        near = rows.join(events.select("window_id", F.col("event").alias("candidate")), "window_id").select("entity", "window_id", "n_peers", F.concat(F.lit("event: "), "candidate").alias("candidate"), F.lit(0.5).alias("confidence"))
        found = found.unionByName(near)
    place = F.row_number().over(Window.partitionBy("entity", "window_id").orderBy(F.desc("confidence"), "candidate"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def hidden_mass_hypothesis(anomalies: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many anomalies, and what they suggest."""
    g = anomalies.groupBy(*keys).agg(F.count("*").alias("n_anomalies"))
    n = F.col("n_anomalies")
    return g.withColumn("hypothesis", F.when(n >= 5, "persistent_factor").when(n >= 2, "episodic_factor").when(n == 1, "artifact_or_rare_event").otherwise("no_anomalies")).withColumn("confidence", F.when(n >= 5, 0.7).when(n >= 2, 0.5).when(n == 1, 0.3).otherwise(0.0))


def cohort_velocity(moved: DataFrame, keys=("cohort_id",), limit: float = 0.3) -> DataFrame:
    """(cohort_id, entity, window_id, displacement): correlation of each member's displacement with the mean of the others, and whether it moves apart."""
    w = Window.partitionBy(*keys, "window_id")
    rest = div(F.sum("displacement").over(w) - F.col("displacement"), F.nullif((F.count("displacement").over(w) - 1).cast("double"), F.lit(0.0)))
    g = moved.where(F.col("displacement").isNotNull()).withColumn("rest", rest).groupBy(*keys, "entity").agg(safe_corr(F.col("displacement"), F.col("rest")).alias("velocity_corr"), F.count("rest").alias("n"))
    return g.withColumn("apart", F.coalesce(F.col("velocity_corr") < limit, F.lit(False)))


# ---- residual physics


def _literal(row) -> Column:
    return F.array(*[F.lit(float(x)) for x in row])


def project(v: Column, matrix) -> Column:
    """Matrix (rows as literals) times an array column."""
    return F.array(*[dot(_literal(row), v) for row in matrix])


def state_geometry(vectors: DataFrame, components: int, vector: str = "vector", ridge: float = 1e-6) -> dict:
    """Principal axes (first ``components``), covariance and its ridged inverse, from sums: dimension squared numbers come to the driver."""
    dim = vectors.select(F.max(F.size(vector))).first()[0]
    x = [F.get(F.col(vector), F.lit(i)) for i in range(dim)]
    sums = vectors.agg(*[F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in range(dim) for j in range(i, dim)]).first()
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = sums[f"c_{i}_{j}"]
    from geoloom.kernels.cohort import eigen

    w, v = eigen(cov)
    return {"basis": v[:, :components].T.tolist(), "covariance": cov.tolist(), "precision": np.linalg.inv(cov + ridge * np.eye(dim)).tolist(), "values": w.tolist()}


def physics(vectors: DataFrame, basis, precision, variances=None, metric: str = "natural", threshold: float = 2.0, min_dof: float = 0.1, keys=ENTITY, vector: str = "vector") -> DataFrame:
    """Motion of each vector and what of it leaves the manifold spanned by ``basis`` (orthonormal rows).

    Needs importance, dof and expected_volatility of the entity.  The residual
    is measured by the natural (x' S^-1 x), diagonal or Euclidean metric;
    hidden mass is the residual times importance over degrees of freedom.
    """
    rows = velocities(vectors, keys, vector).where(F.col("velocity").isNotNull())
    basis = [list(map(float, b)) for b in basis]
    onto = np.array(basis).T @ np.array(basis)
    rows = rows.withColumn("__r", F.zip_with("velocity", project(F.col("velocity"), onto), lambda x, y: x - y))

    def length(v: Column) -> Column:
        if metric == "natural":
            return F.sqrt(F.greatest(quadratic(v, precision), F.lit(0.0)))
        if metric == "diagonal":
            return F.sqrt(zip_sum(v, _literal(variances), lambda x, s: x * x / (s + F.lit(EPS))))
        return norm(v)

    rows = rows.withColumn("residual", length(F.col("__r"))).withColumn("residual_euclidean", norm(F.col("__r")))
    mass = F.col("importance") / F.greatest(F.lit(min_dof), F.col("dof"))
    rows = rows.withColumn("hidden_mass", F.col("residual") * mass).withColumn("significant", F.col("residual") > threshold).withColumn("self_influence", quadratic(F.col(vector), precision))
    rows = rows.withColumn("phase_velocity", project(F.col("velocity"), basis)).withColumn("kinetic_energy", 0.5 * mass * length(F.col("velocity")) * length(F.col("velocity")))
    rows = rows.withColumn("constraint_tension", F.col("residual") / F.greatest("expected_volatility", F.lit(EPS))).withColumn("amplification", F.when(F.col("residual") > 0, F.col("residual_euclidean") / F.greatest("residual", F.lit(EPS))).otherwise(1.0))
    return rows.drop("__r")


def _turn(line) -> Column:
    """Cosine of the phase velocity with the one before; null where either stands still."""
    now, before = F.col("phase_velocity"), F.lag("phase_velocity").over(line)
    moving = (norm(now) > EPS) & (norm(before) > EPS)
    return F.when(moving, dot(now, before) / (norm(now) * norm(before)))


def resistance(states: DataFrame, importance_median: float, history: int = 20, least: int = 5, keys=ENTITY) -> DataFrame:
    """Adds resistance (.4 steady direction + .3 steady speed + .3 steady hidden mass over the states before) and the stability class."""
    line = _line(keys)
    rows = states.withColumn("__cos", _turn(line)).withColumn("__speed", norm(F.col("phase_velocity")))
    past, turns = line.rowsBetween(-history, -1), line.rowsBetween(-(history - 1), -1)
    first = F.row_number().over(line)
    direction = F.coalesce(F.avg((F.col("__cos") + 1) / 2).over(turns), F.lit(0.5))
    mean = F.avg("__speed").over(past)
    magnitude = F.when(mean > EPS, 1 / (1 + F.stddev_pop("__speed").over(past) / mean)).otherwise(0.5)
    smooth = 1 / (1 + F.var_pop("hidden_mass").over(past))
    score = F.when(first > least, clip(0.4 * direction + 0.3 * magnitude + 0.3 * smooth, 0.0, 1.0)).otherwise(0.5)
    rows = rows.withColumn("resistance", score)
    rare = F.col("self_influence") < importance_median
    kind = F.when(F.col("resistance") > 0.5, F.when(rare, "rigid").otherwise("stable")).otherwise(F.when(rare, "fluid").otherwise("volatile"))
    return rows.withColumn("stability_class", kind).drop("__cos", "__speed")


def trajectory_analysis(states: DataFrame, keys=ENTITY) -> DataFrame:
    """Per entity: hidden mass, its events and lag-1 persistence, steadiness of direction, regime changes (sign of the first phase velocity) and the current one's length."""
    line, every = _line(keys), Window.partitionBy(*keys)
    sign = F.signum(F.get("phase_velocity", F.lit(0)))
    rows = states.withColumn("cos", _turn(line)).withColumn("sign", sign).withColumn("c", F.col("hidden_mass") - F.avg("hidden_mass").over(every))
    rows = rows.withColumn("next_c", F.lead("c").over(line)).withColumn("turned", (F.col("sign") != F.lag("sign").over(line)).cast("int"))
    rows = rows.withColumn("since", F.sum(F.coalesce("turned", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.max("since").over(every))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.sum("hidden_mass").alias("total_hidden_mass"), F.sum(F.col("significant").cast("int")).alias("hidden_mass_events"), F.coalesce(F.avg("cos"), F.lit(0.0)).alias("direction_consistency"),
        F.coalesce(div(F.sum(F.col("c") * F.col("next_c")), F.nullif(F.sum(F.col("c") * F.col("c")), F.lit(0.0))), F.lit(0.0)).alias("__p"), F.coalesce(F.sum("turned"), F.lit(0)).alias("regime_transitions"), F.sum((F.col("since") == F.col("last")).cast("int")).alias("current_regime_duration"),
    )
    return g.withColumn("hidden_mass_persistence", F.when(F.col("n_observations") > 3, F.col("__p")).otherwise(0.0)).drop("__p")


def hidden_mass_events(states: DataFrame, sigma: float = 2.0, least: int = 5, keys=ENTITY) -> DataFrame:
    """States whose hidden mass lies over ``sigma`` deviations above the entity's mean."""
    every = Window.partitionBy(*keys)
    z = div(F.col("hidden_mass") - F.avg("hidden_mass").over(every), F.nullif(F.stddev_pop("hidden_mass").over(every), F.lit(0.0)))
    return states.withColumn("z", z).withColumn("__n", F.count("*").over(every)).where((F.col("__n") >= least) & (F.col("z") > sigma)).drop("__n")


def hidden_mass_episodes(states: DataFrame, sigma: float = 2.0, least: int = 5, keys=ENTITY) -> DataFrame:
    """Runs of windows whose hidden mass lies over mean + ``sigma`` deviations: first, last, frames, peak and its z."""
    every = Window.partitionBy(*keys)
    mean, sd = F.avg("hidden_mass").over(every), F.stddev_pop("hidden_mass").over(every)
    rows = states.withColumn("__z", div(F.col("hidden_mass") - mean, F.nullif(sd, F.lit(0.0)))).withColumn("__n", F.count("*").over(every))
    rows = islands(rows.withColumn("__high", F.coalesce(F.col("__z") > sigma, F.lit(False))), "__high", keys, "window_id").where(F.col("__high") & (F.col("__n") >= least))
    g = rows.groupBy(*keys, "run").agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"), F.count("*").alias("duration_frames"), F.max("hidden_mass").alias("peak"), F.max("__z").alias("z"))
    return g.drop("run").withColumn("severity", F.when(F.col("z") > 3, "extreme").otherwise("significant"))


def momentum(frames: DataFrame, value: str = "mean_tension", keys: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """(window_id, tension): weighted mean of the last changes (the newest weighs most, e times the oldest), and its own change; 0 before the third window."""
    line = Window.partitionBy(*keys).orderBy("window_id")
    rows = frames.withColumn("__d", F.col(value) - F.lag(value).over(line))
    rows = rows.withColumn("__k", F.count("__d").over(line.rowsBetween(-(most - 1), 0)))
    weights = [F.when(F.col("__k") > i, F.exp(-F.lit(float(i)) / F.greatest(F.col("__k") - 1, F.lit(1)))) for i in range(most)]
    parts = [F.coalesce(w * F.lag("__d", i).over(line), F.lit(0.0)) for i, w in enumerate(weights)]
    total = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for w in weights])
    rows = rows.withColumn("momentum", F.when(F.col("__k") >= 2, reduce(lambda a, b: a + b, parts) / total).otherwise(0.0))
    before = F.lag("momentum").over(line)
    return rows.withColumn("acceleration", F.when(F.col("__k") >= 2, F.col("momentum") - F.coalesce(before, F.lit(0.0))).otherwise(0.0)).drop("__d", "__k")


def cohort_tension(states: DataFrame, keys=("window_id",), stress: float = 0.5) -> DataFrame:
    """(window_id, cohort_id, hidden_mass): mean hidden mass of each cohort; critical above ``stress`` times the cohorts' mean."""
    g = states.groupBy(*keys, "cohort_id").agg(F.avg("hidden_mass").alias("tension"), F.count("*").alias("n"))
    return g.withColumn("critical", F.col("tension") > stress * F.avg("tension").over(Window.partitionBy(*keys)))


def deformation_type(states: DataFrame, keys=("window_id",)) -> DataFrame:
    """(window_id, direction array, magnitude): minimal, expansion, compression, shear or rotation, by the length of the mean deformation over all magnitudes and the share of the first axis."""
    g = states.groupBy(*keys).agg(F.sum("magnitude").alias("total"), F.avg(F.abs(F.get("direction", F.lit(0))) * F.col("magnitude")).alias("__first"), F.avg(F.get("direction", F.lit(0)) * F.col("magnitude")).alias("__mean"))
    per = states.select(*keys, "magnitude", F.posexplode("direction").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x") * F.col("magnitude")).alias("m")).groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("__norm"))
    rows = g.join(per, list(keys)).withColumn("coherence", div(F.col("__norm"), F.nullif(F.col("total"), F.lit(0.0)))).withColumn("first_axis", div(F.col("__first"), F.nullif(F.col("total"), F.lit(0.0))))
    aligned = F.when(F.col("first_axis") > 0.5, F.when(F.col("__mean") > 0, "expansion").otherwise("compression")).otherwise("shear")
    return rows.withColumn("kind", F.when(F.col("total") < EPS, "minimal").when(F.col("coherence") > 0.7, aligned).otherwise("rotation")).drop("__first", "__mean", "__norm")


def system_deformation(states: DataFrame) -> DataFrame:
    """Hidden mass by stability class, and of all (class null)."""
    return states.rollup("stability_class").agg(F.count("*").alias("n_states"), F.count_distinct("entity").alias("n_entities"), F.sum("hidden_mass").alias("total_hidden_mass"), F.avg("hidden_mass").alias("mean_hidden_mass"), F.stddev_pop("hidden_mass").alias("std_hidden_mass"), F.avg("amplification").alias("mean_amplification"))


# ---- assembly of engine outputs


def assemble(outputs: DataFrame, frame=FRAME, keys=("indicator_id", "window_id")) -> DataFrame:
    """(keys, engine, output_key, value, confidence) -> vector over the frame (missing dimensions 0), coverage and effective confidence."""
    at = F.create_map(*[x for i, (e, k, _) in enumerate(frame) for x in (F.lit(f"{e}.{k}"), F.lit(i))])
    logged = [i for i, f in enumerate(frame) if f[2] == "log"]
    rows = outputs.withColumn("dim", F.element_at(at, F.concat_ws(".", "engine", "output_key"))).where(F.col("dim").isNotNull() & F.col("value").isNotNull())
    value = F.when(F.col("dim").isin(logged) & (F.col("value") > 0), F.ln(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value"))
    rows = rows.withColumn("value", value)
    cells = [F.coalesce(F.max(F.when(F.col("dim") == i, F.col("value"))), F.lit(0.0)) for i in range(len(frame))]
    g = rows.groupBy(*keys).agg(F.array(*cells).alias("vector"), (F.count_distinct("dim") / F.lit(len(frame))).alias("coverage"), F.sum(F.coalesce("confidence", F.lit(1.0))).alias("__w"))
    return g.withColumn("effective_confidence", F.when(F.col("__w") > 0, 1.0).otherwise(0.0)).drop("__w")


# ---- validation of system geometry


def validate_geometry(rows: DataFrame) -> DataFrame:
    """(window_id, n_indicators, effective_dimension, shares array, density, dispersion): whether the geometry of a window is well formed."""
    ratio = F.col("effective_dimension") / F.col("n_indicators")
    mean = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x) / F.size("shares")
    spread = F.sqrt(F.aggregate("shares", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("shares"))
    gap = div(F.get("shares", F.lit(0)), F.get("shares", F.lit(1)))
    several = F.size("shares") > 1
    checks = [
        ("too_few_indicators", F.col("n_indicators") < 5, 0.3), ("dimension_too_high", ratio > 0.8, 0.2), ("dimension_too_low", ratio < 0.1, 0.1), ("degenerate_spectrum", several & (spread < 0.01), 0.2), ("weak_first_gap", several & (F.get("shares", F.lit(1)) > 0) & (gap < 1.5), 0.1),
        ("sparse_network", F.col("density") < 0.1, 0.1), ("dense_network", F.col("density") > 0.9, 0.0), ("uniform_correlations", F.col("dispersion") < 0.01, 0.15),
    ]
    return _judged(rows.withColumn("dimension_ratio", ratio).withColumn("pc_gap", gap), checks)


def validate_positions(rows: DataFrame, keys=("window_id",)) -> DataFrame:
    """(window_id, indicator_id, isolation, centroid_distance, loadings array, n_neighbors): degenerate or outlying positions."""
    every = Window.partitionBy(*keys)
    z = div(F.col("centroid_distance") - F.avg("centroid_distance").over(every), F.nullif(F.stddev_pop("centroid_distance").over(every), F.lit(0.0)))
    strong = F.size(F.filter(F.slice("loadings", 1, 3), lambda x: F.abs(x) > 0.1))
    out = rows.withColumn("centroid_z", z).withColumn("n_meaningful", strong)
    checks = [
        ("isolated", F.col("isolation") > 0.95, 0.2), ("too_central", F.col("isolation") < 0.05, 0.1), ("far_from_centroid", F.abs("centroid_z") > 3, 0.2), ("few_loadings", F.col("n_meaningful") < 2, 0.15), ("no_neighbors", (F.col("n_neighbors") == 0) & (F.col("isolation") < 0.9), 0.1),
    ]
    return _judged(out, checks)


def calibrate_constraints(rows: DataFrame, keys=("window_id",)) -> DataFrame:
    """(window_id, indicator_id, dof, volatility, mean_reversion, centrality): bounds of the behavioural constraints."""
    every = Window.partitionBy(*keys)
    z = F.when(F.count("volatility").over(every) > 3, div(F.col("volatility") - F.avg("volatility").over(every), F.nullif(F.stddev_pop("volatility").over(every), F.lit(0.0))))
    out = rows.withColumn("volatility_z", z)
    checks = [
        ("over_constrained", F.col("dof") < 1.0, 0.2), ("under_constrained", F.col("dof") > 10.0, 0.1), ("extreme_volatility", F.abs("volatility_z") > 3.0, 0.15), ("reversion_out_of_bounds", ~F.col("mean_reversion").between(0.0, 1.0), 0.1),
        ("central_but_free", (F.col("centrality") > 0.7) & (F.col("dof") > 5), 0.1),
    ]
    return _judged(out, checks)


def score_relevance(rows: DataFrame) -> DataFrame:
    """(structural_centrality, eigenvector_centrality, information_value, influence, sensitivity): composite relevance .4/.3/.3, role by influence over sensitivity."""
    ratio = div(F.col("influence"), F.nullif(F.col("sensitivity"), F.lit(0.0)))
    role = F.when(ratio > 5, "strong_leader").when(ratio > 1.5, "leader").when(ratio < 0.2, "strong_follower").when(ratio < 0.67, "follower").otherwise("balanced")
    score = clip(0.4 * F.col("structural_centrality") + 0.3 * F.col("eigenvector_centrality") + 0.3 * F.col("information_value"), 0.0, 1.0)
    odd = (F.col("structural_centrality") > 0.7) & (F.col("eigenvector_centrality") < 0.2)
    return rows.withColumn("relevance", score).withColumn("role", role).withColumn("status", F.when(odd, "marginal").otherwise("valid"))


def relevance_distribution(scored: DataFrame, keys: tuple[str, ...] = ("window_id",), high: float = 0.7, low: float = 0.1) -> DataFrame:
    """Moments of the relevance in each window, how many are high or low, and flags."""
    g = scored.groupBy(*keys).agg(
        F.count("*").alias("n_indicators"), F.avg("relevance").alias("mean_relevance"), F.stddev_pop("relevance").alias("std_relevance"), F.min("relevance").alias("min_relevance"), F.max("relevance").alias("max_relevance"), F.median("relevance").alias("median_relevance"),
        F.sum((F.col("relevance") >= high).cast("int")).alias("n_high"), F.sum((F.col("relevance") <= low).cast("int")).alias("n_low"),
    )
    flags = {"little_variation": F.col("std_relevance") < 0.05, "none_high": F.col("n_high") == 0, "mostly_low": F.col("n_low") > 0.5 * F.col("n_indicators")}
    return g.withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()])))


# ---- states of windows


def state_ranges(states: DataFrame, gap_days: int = 60) -> DataFrame:
    """(date, state): contiguous periods of each state; a gap of more than ``gap_days`` begins another."""
    line = Window.partitionBy("state").orderBy("date")
    opens = F.coalesce(F.datediff("date", F.lag("date").over(line)) > gap_days, F.lit(True)).cast("int")
    rows = states.withColumn("__o", opens).withColumn("period", F.sum("__o").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("state", "period").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_points"))


def dwell(states: DataFrame, keys=("indicator_id",), order: str = "date") -> DataFrame:
    """(keys, date, state): days, share, stays and mean length of stay of each state."""
    runs = islands(states, "state", keys, order).groupBy(*keys, "run", "state").agg(F.count("*").alias("length"))
    g = runs.groupBy(*keys, "state").agg(F.sum("length").alias("n"), F.avg("length").alias("mean_dwell_time"), F.count("*").alias("n_episodes"))
    return g.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def regime_label(mean_corr: Column, dispersion: Column, n_clusters: Column, n_indicators: Column) -> Column:
    """crisis (dispersion above .4), aligned (mean above .6 and few clusters), divergent (mean below .3 or many clusters), transitioning."""
    share = n_clusters / F.greatest(n_indicators, F.lit(1))
    return F.when(dispersion > 0.4, "crisis").when((mean_corr > 0.6) & (share < 0.3), "aligned").when((mean_corr < 0.3) | (share > 0.5), "divergent").otherwise("transitioning")


def regime_periods(labelled: DataFrame, order: str = "window_id") -> DataFrame:
    """(window_id, regime): runs of one regime.  One row a window: a single ordered pass."""
    return islands(labelled.withColumn("__one", F.lit(1)), "regime", ("__one",), order).groupBy("run", "regime").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_windows")).drop("run")


# ---- consensus of engines


def consensus_report(contributions: DataFrame, keys=("window_id",), limit: float = 0.2) -> DataFrame:
    """(window_id, engine, capped_weight, contributing): normalised weights, the largest shift of any other engine's share when one is left out, and who the window is vulnerable to."""
    on = contributions.withColumn("__w", F.when(F.col("contributing"), F.col("capped_weight")).otherwise(0.0))
    every = Window.partitionBy(*keys)
    best = F.row_number().over(every.orderBy(F.desc(F.col("contributing").cast("int")), F.desc("__w"), "engine"))
    rows = on.withColumn("__t", F.sum("__w").over(every)).withColumn("__n", F.sum(F.col("contributing").cast("int")).over(every)).withColumn("__place", best)
    rows = rows.withColumn("__top", F.max(F.when(F.col("__place") == 1, F.col("__w"))).over(every)).withColumn("__second", F.max(F.when((F.col("__place") == 2) & F.col("contributing"), F.col("__w"))).over(every))
    other = F.when(F.col("__place") == 1, F.col("__second")).otherwise(F.col("__top"))
    # share c / (T - w) less c / T for the heaviest other engine c
    shift = F.when(F.col("contributing") & (F.col("__n") >= 2), div(other * F.col("__w"), F.col("__t") * F.nullif(F.col("__t") - F.col("__w"), F.lit(0.0))))
    rows = rows.withColumn("normalized_weight", F.when(F.col("contributing"), div(F.col("__w"), F.nullif(F.col("__t"), F.lit(0.0))))).withColumn("shift", shift)
    rows = rows.withColumn("vulnerable", F.coalesce(F.col("shift") > limit, F.lit(False))).withColumn("max_weight_shift", F.coalesce(F.max("shift").over(every), F.lit(0.0)))
    rows = rows.withColumn("stable", (F.col("__n") >= 2) & (F.max(F.col("vulnerable").cast("int")).over(every) == 0))
    return rows.drop("__w", "__t", "__n", "__place", "__top", "__second")


class DiagnosticRegistry:
    """Metrics and decisions of agents by window, appended as Parquet; what a table says last about a metric counts."""

    METRICS = "agent string, metric string, window_id string, value double, seq long"
    AUDIT = "agent string, decision string, reason string, window_id string, seq long"

    def __init__(self, spark, path: str):
        self.spark, self.path, self.held, self.audit, self.seq = spark, path.rstrip("/"), [], [], 0

    def store(self, agent: str, metric: str, value: float, window_id: str = "_global") -> None:
        self.seq += 1
        self.held.append((agent, metric, window_id, float(value), self.seq))

    def decide(self, agent: str, decision: str, reason: str = "", window_id: str = "_global") -> None:
        self.seq += 1
        self.audit.append((agent, decision, reason, window_id, self.seq))

    def flush(self) -> None:
        for rows, schema, name in ((self.held, self.METRICS, "metrics"), (self.audit, self.AUDIT, "audit")):
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        self.held, self.audit = [], []

    def metrics(self) -> DataFrame:
        self.flush()
        rows = self.spark.read.schema(self.METRICS).parquet(f"{self.path}/metrics")
        return rows.groupBy("agent", "metric", "window_id").agg(F.max_by("value", "seq").alias("value"))

    def trail(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(self.AUDIT).parquet(f"{self.path}/audit")
