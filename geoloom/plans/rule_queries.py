"""Queries on quality gates, routing, contributions, state vectors and validation rules, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from geoloom.operators import dynamics, panel as P, policy, vectors
from geoloom.plans.native_queries import BY, query, rounded
from geoloom.plans.panel_queries import MOTION, TALL, WCORR, _tall, yearly_corr
from geoloom.plans.panels import EVENTS_BY_USER, EVENTS_HOURLY, NATION_MONTHLY, events_by_user, events_hourly, nation_monthly, table

# ---- quality of raw against cleaned values


@query(f"WITH {EVENTS_HOURLY} SELECT indicator_id, round(avg((extract(hour FROM date) % 11 = 0)::INT), 6) AS missing_rate, count(*) AS n, avg((extract(hour FROM date) % 11 = 0)::INT) <= 0.10 AS ok FROM events_hourly GROUP BY 1")
def missing_gate(spark, sf_dir):
    gappy = events_hourly(spark, sf_dir).withColumn("value", F.when(F.hour("date") % 11 != 0, F.col("value")))
    return rounded(policy.missing_gate(gappy, multivariate=False))


@query(f"WITH {EVENTS_BY_USER}, g AS (SELECT indicator_id, date - lag(date) OVER (PARTITION BY indicator_id ORDER BY date) AS gap FROM events_by_user) SELECT indicator_id, round(stddev_pop(gap) / nullif(quantile_cont(gap::DOUBLE, 0.5), 0), 6) AS irregularity, count(*) AS n, coalesce(stddev_pop(gap) / nullif(quantile_cont(gap::DOUBLE, 0.5), 0) <= 0.01, true) AS ok FROM g GROUP BY 1")
def frequency_gate(spark, sf_dir):
    return rounded(policy.frequency_gate(events_by_user(spark, sf_dir)))


BOTH = "bo AS (SELECT indicator_id, date, value AS raw, least(greatest(value, 100), 300) AS cleaned FROM events_hourly)"


def _both(spark, sf_dir):
    return events_hourly(spark, sf_dir).select("indicator_id", "date", F.col("value").alias("raw"), F.least(F.greatest("value", F.lit(100.0)), F.lit(300.0)).alias("cleaned"))


@query(f"""WITH {EVENTS_HOURLY}, {BOTH}, k AS (SELECT *, greatest(floor(count(cleaned) {BY} * 0.02), 1) AS k, row_number() OVER (PARTITION BY indicator_id ORDER BY cleaned) AS u, row_number() OVER (PARTITION BY indicator_id ORDER BY cleaned DESC) AS d FROM bo),
g AS (SELECT indicator_id, count(cleaned) AS n, covar_samp(CASE WHEN raw > 0 THEN ln(raw) END, cleaned) / nullif(stddev_samp(CASE WHEN raw > 0 THEN ln(raw) END) * stddev_samp(CASE WHEN raw > 0 THEN cleaned END), 0) AS lc, covar_samp(raw, cleaned) / nullif(stddev_samp(raw) * stddev_samp(cleaned), 0) AS vc, 1 - (max(cleaned) - min(cleaned)) / nullif(max(raw) - min(raw), 0) AS rs,
 min(cleaned) FILTER (WHERE u <= k) AS lo, max(cleaned) FILTER (WHERE u = k + 1) AS li, max(cleaned) FILTER (WHERE d <= k) AS hi, max(cleaned) FILTER (WHERE d = k + 1) AS hj FROM k GROUP BY 1)
SELECT indicator_id, round(lc, 6) AS log_corr, round(vc, 6) AS level_corr, round(rs, 6) AS range_shrink, n, coalesce(abs(lo - li) <= 0.01 * abs(li) + 1e-8, false) AS flat_low, coalesce(abs(hi - hj) <= 0.01 * abs(hj) + 1e-8, false) AS flat_high, coalesce(lc > 0.95 AND vc < lc, false) AS log_transformed, n >= 10 AND (coalesce(rs > 0.05, false) OR coalesce(abs(lo - li) <= 0.01 * abs(li) + 1e-8, false) OR coalesce(abs(hi - hj) <= 0.01 * abs(hj) + 1e-8, false)) AS winsorised, false AS climate, true AS compliant FROM g""")
def outlier_policy(spark, sf_dir):
    return rounded(policy.outlier_policy(_both(spark, sf_dir)))


@query(f"""WITH {EVENTS_HOURLY}, z AS (SELECT indicator_id, (value - avg(value) {BY}) / nullif(stddev_samp(value) {BY}, 0) AS value FROM events_hourly), m AS (SELECT *, median(value) {BY} AS med FROM z), g AS (SELECT indicator_id, avg(value) AS mean, stddev_samp(value) AS sd, max(med) AS median, quantile_cont(abs(value - med), 0.5) AS mad, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1)
SELECT indicator_id, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(mad, 6) AS mad, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN abs(mean) < 0.1 AND abs(sd - 1) < 0.1 THEN 'zscore' WHEN abs(median) < 0.1 AND abs(mad * 1.4826 - 1) < 0.1 THEN 'robust_z' WHEN lo >= 0 AND hi <= 1 AND abs(mean - 0.5) < 0.05 THEN 'rank' ELSE 'none' END AS scaling FROM g""")
def scaling_kind(spark, sf_dir):
    return rounded(policy.scaling_kind(P.zscore(events_hourly(spark, sf_dir))))


CHECKS = "ck AS (SELECT CAST(o_custkey AS VARCHAR) AS indicator_id, o_orderpriority AS \"check\", CASE WHEN o_totalprice > 450000 THEN 'critical' WHEN o_totalprice > 250000 THEN 'warning' ELSE 'info' END AS severity FROM orders)"
FLAGS = f"{CHECKS}, fl AS (SELECT indicator_id, CAST(sum((severity = 'critical')::INT) AS BIGINT) AS n_critical, CAST(sum((severity = 'warning')::INT) AS BIGINT) AS n_warning FROM ck GROUP BY 1), ff AS (SELECT *, CASE WHEN n_critical > 0 THEN 'unsafe' WHEN n_warning >= 2 THEN 'questionable' ELSE 'safe' END AS flag FROM fl)"


def _flags(spark, sf_dir):
    severity = F.when(F.col("o_totalprice") > 450000, "critical").when(F.col("o_totalprice") > 250000, "warning").otherwise("info")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("indicator_id"), F.col("o_orderpriority").alias("check"), severity.alias("severity"))
    return policy.safety_flag(o)


@query(f"WITH {FLAGS} SELECT * FROM ff")
def safety_flag(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(f"WITH {FLAGS} SELECT ['safe', 'questionable', 'unsafe'][max(CASE flag WHEN 'unsafe' THEN 3 WHEN 'questionable' THEN 2 ELSE 1 END)] AS flag FROM ff")
def worst_flag(spark, sf_dir):
    return policy.worst_flag(_flags(spark, sf_dir))


# ---- geometry of views, suitability, routing


VIEWS = """vw AS (SELECT CAST(c_nationkey AS VARCHAR) AS indicator_id, CASE c_custkey % 4 WHEN 0 THEN 'LEVEL' WHEN 1 THEN 'RETURNS' WHEN 2 THEN 'VOLATILITY' ELSE 'DEVIATION' END AS view, CASE c_mktsegment WHEN 'BUILDING' THEN 'latent_flow' WHEN 'MACHINERY' THEN 'coupled_oscillator' WHEN 'HOUSEHOLD' THEN 'pure_noise' ELSE 'reflexive_stochastic' END AS geometry, (c_acctbal + 1000) / 11000 AS confidence, c_custkey AS window_id FROM customer)"""


def _views(spark, sf_dir):
    seg = F.col("c_mktsegment")
    k = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("indicator_id"), F.when(k == 0, "LEVEL").when(k == 1, "RETURNS").when(k == 2, "VOLATILITY").otherwise("DEVIATION").alias("view"),
        F.when(seg == "BUILDING", "latent_flow").when(seg == "MACHINERY", "coupled_oscillator").when(seg == "HOUSEHOLD", "pure_noise").otherwise("reflexive_stochastic").alias("geometry"), ((F.col("c_acctbal") + 1000) / 11000).alias("confidence"), F.col("c_custkey").alias("window_id"),
    )


@query(f"""WITH {VIEWS}, v AS (SELECT indicator_id, geometry, sum(confidence * CASE view WHEN 'LEVEL' THEN 0.30 WHEN 'RETURNS' THEN 0.35 WHEN 'VOLATILITY' THEN 0.25 ELSE 0.30 END) AS vote FROM vw GROUP BY 1, 2), r AS (SELECT *, vote / sum(vote) OVER (PARTITION BY indicator_id) AS share, row_number() OVER (PARTITION BY indicator_id ORDER BY vote DESC, geometry) AS k FROM v)
SELECT indicator_id, geometry AS dominant_geometry, round(share, 6) AS consensus, round(1 - share, 6) AS disagreement FROM r WHERE k = 1""")
def arbitration(spark, sf_dir):
    return rounded(policy.arbitrate(_views(spark, sf_dir)))


@query(f"""WITH {VIEWS}, l AS (SELECT *, lag(geometry) OVER (PARTITION BY indicator_id ORDER BY window_id) AS b FROM vw), c AS (SELECT *, coalesce(geometry <> b, false) AS changed FROM l)
SELECT indicator_id, view, geometry, round(confidence, 6) AS confidence, window_id, changed, CASE WHEN changed THEN b || ' -> ' || geometry END AS transition, round(sum(changed::INT) OVER (PARTITION BY indicator_id) / nullif(count(*) OVER (PARTITION BY indicator_id) - 1, 0), 6) AS transition_rate FROM c""")
def geometry_scan(spark, sf_dir):
    return rounded(policy.geometry_scan(_views(spark, sf_dir)), 6)


SCORES3 = "s3 AS (SELECT c_custkey, least(greatest((c_acctbal + 1000) / 11000, 0), 1) AS a, (c_custkey % 10) / 10.0::DOUBLE AS b, (c_nationkey % 5) / 5.0::DOUBLE AS c FROM customer)"


@query(f"""WITH {SCORES3}, o AS (SELECT *, list_reverse_sort([a, b, c]) AS s FROM s3) SELECT c_custkey, round(CASE WHEN c >= 0.6 THEN 0.2 ELSE 0.7 * s[1] + 0.3 * (s[1] - s[2]) END, 6) AS confidence, (a >= 0.5)::INT + (b >= 0.5)::INT >= 2 AS hybrid FROM o""")
def signature_confidence(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.least(F.greatest((F.col("c_acctbal") + 1000) / 11000, F.lit(0.0)), F.lit(1.0)).alias("a"), ((F.col("c_custkey") % 10) / 10.0).alias("b"), ((F.col("c_nationkey") % 5) / 5.0).alias("c"))
    confidence, hybrid = policy.signature_confidence(["a", "b", "c"], noise="c")
    return rounded(t.select("c_custkey", confidence.alias("confidence"), hybrid.alias("hybrid")))


SCAN = """wn AS (SELECT CAST(c_nationkey AS VARCHAR) AS indicator_id, c_custkey % 7 + 0.5 AS window_years, CASE c_custkey % 4 WHEN 0 THEN 'latent_flow' WHEN 1 THEN 'coupled_oscillator' WHEN 2 THEN 'pure_noise' ELSE 'reflexive_stochastic' END AS dominant_geometry, (c_custkey % 100) / 100.0::DOUBLE AS geometry_pct, CAST(c_custkey % 40 AS INTEGER) AS n_observations, (c_acctbal + 1000) / 11000 AS avg_confidence, (c_custkey % 13) / 13.0::DOUBLE AS avg_disagreement, (c_custkey % 9) / 9.0::DOUBLE AS stability, (c_custkey % 5) / 4.0::DOUBLE AS coverage, c_custkey FROM customer)"""


def _scan(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    geometry = F.when(k % 4 == 0, "latent_flow").when(k % 4 == 1, "coupled_oscillator").when(k % 4 == 2, "pure_noise").otherwise("reflexive_stochastic")
    return c.select(
        F.col("c_nationkey").cast("string").alias("indicator_id"), ((k % 7).cast("double") + 0.5).alias("window_years"), geometry.alias("dominant_geometry"), ((k % 100) / 100.0).alias("geometry_pct"), (k % 40).cast("int").alias("n_observations"), ((F.col("c_acctbal") + 1000) / 11000).alias("avg_confidence"),
        ((k % 13) / 13.0).alias("avg_disagreement"), ((k % 9) / 9.0).alias("stability"), ((k % 5) / 4.0).alias("coverage"), "c_custkey",
    )


QUALITY = f"{SCAN}, ql AS (SELECT *, 0.40 * avg_confidence + 0.30 * (1 - avg_disagreement) + 0.20 * stability + 0.10 * coverage AS quality_score FROM wn)"


@query(f"WITH {QUALITY} SELECT c_custkey, indicator_id, CAST(window_years AS DOUBLE) AS window_years, round(quality_score, 6) AS quality_score FROM ql")
def window_quality(spark, sf_dir):
    return rounded(policy.quality_score(_scan(spark, sf_dir)).select("c_custkey", "indicator_id", "window_years", "quality_score"))


_ALLOWED = {g: sorted({*policy.UNIVERSAL, *e}) for g, e in policy.GEOMETRY_ENGINES.items()}


@query(f"""WITH {QUALITY}, t AS (SELECT *, CASE WHEN window_years < 1.5 THEN 0.25 ELSE 0.30 END AS mc, CASE WHEN window_years < 1.5 THEN 0.60 ELSE 0.50 END AS ms, n_observations < 10 OR (dominant_geometry = 'pure_noise' AND geometry_pct > 0.70) AS bad FROM ql),
d AS (SELECT *, list_filter([CASE WHEN quality_score < 0.35 THEN 'low_quality' END, CASE WHEN avg_confidence < mc THEN 'low_confidence' END, CASE WHEN avg_disagreement > 0.65 THEN 'high_disagreement' END, CASE WHEN stability < ms THEN 'low_stability' END, CASE WHEN window_years >= 5 AND geometry_pct > 0.95 THEN 'over_smoothing' END], lambda x: x IS NOT NULL) AS why FROM t)
SELECT c_custkey, CASE WHEN bad THEN 'ineligible' WHEN len(why) > 0 THEN 'conditional' ELSE 'eligible' END AS status, CASE WHEN bad THEN '' ELSE array_to_string(why, ',') END AS reasons, array_to_string(CASE WHEN bad THEN {policy.NOISE_ALLOWED} {' '.join(f"WHEN dominant_geometry = '{g}' THEN {e}" for g, e in _ALLOWED.items())} END, ',') AS allowed_engines FROM d""")
def suitability(spark, sf_dir):
    got = policy.suitability(policy.quality_score(_scan(spark, sf_dir)))
    return got.select("c_custkey", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("allowed_engines", ",").alias("allowed_engines"))


GATES = "gt(engine, gate, min_window, requires_null) AS (VALUES " + ", ".join(f"('{e}', '{s}', {policy.MIN_WINDOW.get(e) or 'NULL'}, {str(e in policy.REQUIRES_NULL).lower()})" for s, names in policy.STATUS.items() for e in names) + ")"


@query(f"WITH {GATES} SELECT engine, gate, CAST(min_window AS INTEGER) AS min_window, requires_null FROM gt")
def engine_gates(spark, sf_dir):
    return policy.gate_table(spark)


_FIT = "CASE engine " + " ".join(f"WHEN '{e}' THEN {float(v.get('finance', v.get('all', 0.0)))}" for e, v in policy.DOMAIN_FIT.items()) + " ELSE 0.0 END"
_ALIGNED = "CASE engine " + " ".join(f"WHEN '{e}' THEN " + " OR ".join(f"{g} >= {s}" for g, s in opts) for e, opts in policy.ALIGNMENT.items()) + " ELSE true END"


@query(f"""WITH {GATES}, rq AS (SELECT CAST(c_custkey AS VARCHAR) AS window_id, CAST(c_custkey * 37 % 600 AS INTEGER) AS n_obs, (c_custkey % 10) / 10.0::DOUBLE AS latent_flow, (c_custkey % 7) / 7.0::DOUBLE AS oscillator, (c_custkey % 3) / 3.0::DOUBLE AS reflexive, c_custkey % 2 = 0 AS null_passed FROM customer WHERE c_custkey < 60),
j AS (SELECT *, {_FIT} AS fit FROM rq, gt), w AS (SELECT *, CASE WHEN gate = 'excluded' THEN 'excluded' WHEN n_obs < min_window THEN 'window_too_short' WHEN fit <= 0 THEN 'domain' WHEN NOT ({_ALIGNED}) THEN 'geometry' WHEN requires_null AND NOT null_passed THEN 'null_not_passed' END AS reason FROM j),
r AS (SELECT *, reason IS NULL AS runs, CASE WHEN reason IS NULL AND gate <> 'diagnostic' THEN fit * CASE WHEN gate = 'core' THEN 1.0 ELSE 0.7 END ELSE 0.0 END AS raw FROM w), s AS (SELECT *, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY window_id), 0), 0) AS share FROM r), c AS (SELECT *, least(share, 0.25) AS capped, CASE WHEN share < 0.25 THEN share ELSE 0 END AS room FROM s),
x AS (SELECT *, sum(share) OVER (PARTITION BY window_id) - sum(capped) OVER (PARTITION BY window_id) AS spare, room / nullif(sum(room) OVER (PARTITION BY window_id), 0) AS part FROM c)
SELECT window_id, engine, gate, reason, runs, round(fit, 6)::DOUBLE AS domain_fit, round(least(capped + spare * coalesce(part, 0), 0.25), 6) AS weight FROM x""")
def routing(spark, sf_dir):
    k = F.col("c_custkey")
    rq = table(spark, sf_dir, "customer").where("c_custkey < 60").select(k.cast("string").alias("window_id"), (k * 37 % 600).cast("int").alias("n_obs"), ((k % 10) / 10.0).alias("latent_flow"), ((k % 7) / 7.0).alias("oscillator"), ((k % 3) / 3.0).alias("reflexive"), (k % 2 == 0).alias("null_passed"))
    return rounded(policy.route(rq, "finance").select("window_id", "engine", "gate", "reason", "runs", "domain_fit", "weight"))


# ---- scores of engines


SC = "sc AS (SELECT CAST(c_custkey % 3 AS INTEGER) AS window_id, CAST(c_nationkey AS VARCHAR) AS indicator_id, c_mktsegment AS engine, round(avg(c_acctbal) / 10000, 9) AS score, count(*) AS n_obs FROM customer GROUP BY 1, 2, 3)"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 3).cast("int").alias("window_id"), F.col("c_nationkey").cast("string").alias("indicator_id"), F.col("c_mktsegment").alias("engine")).agg(F.round(F.avg("c_acctbal") / 10000, 9).alias("score"), F.count("*").alias("n_obs"))


@query(f"""WITH {SC}, p AS (SELECT a.window_id, a.engine AS engine_1, b.engine AS engine_2, a.score AS x, b.score AS y FROM sc a JOIN sc b ON a.window_id = b.window_id AND a.indicator_id = b.indicator_id AND a.engine < b.engine), c AS (SELECT window_id, engine_1, engine_2, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS r FROM p GROUP BY 1, 2, 3)
SELECT window_id, engine_1, engine_2, round(r, 6) AS corr, CASE WHEN r >= 0.3 THEN 'agree' WHEN r <= -0.3 THEN 'contradict' WHEN r IS NOT NULL THEN 'unrelated' END AS relation FROM c""")
def engine_agreement(spark, sf_dir):
    return rounded(dynamics.agreement(_scores(spark, sf_dir)))


SC1 = f"{SC}, s1 AS (SELECT indicator_id, engine, round(avg(score), 9) AS score FROM sc GROUP BY 1, 2)"


def _scores1(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("indicator_id", "engine").agg(F.round(F.avg("score"), 9).alias("score"))


@query(f"""WITH {SC1}, p AS (SELECT a.engine AS engine_1, b.engine AS engine_2, a.score AS x, b.score AS y FROM s1 a JOIN s1 b ON a.indicator_id = b.indicator_id AND a.engine < b.engine), c AS (SELECT engine_1, engine_2, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS corr FROM p GROUP BY 1, 2) SELECT engine_1, engine_2, round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.05""")
def engine_redundancy(spark, sf_dir):
    return rounded(policy.redundancy(_scores1(spark, sf_dir), 0.05))


@query(f"""WITH {SC}, w AS (SELECT window_id, indicator_id, engine, score AS value, n_obs::DOUBLE AS weight, sum(n_obs::DOUBLE) OVER p AS sw, sum(n_obs * score) OVER p AS sv FROM sc WINDOW p AS (PARTITION BY window_id)), s AS (SELECT *, abs((sv - weight * value) / nullif(sw - weight, 0) - sv / nullif(sw, 0)) AS shift FROM w)
SELECT window_id, indicator_id, engine, round(shift, 6) AS shift, coalesce(shift > 0.002, false) AS critical FROM s""")
def leave_one_out(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("window_id", "indicator_id", "engine", F.col("score").alias("value"), F.col("n_obs").cast("double").alias("weight"))
    return rounded(policy.leave_one_out(rows, 0.002).select("window_id", "indicator_id", "engine", "shift", "critical"))


@query(f"""WITH {SC}, o AS (SELECT window_id, indicator_id, engine, CASE WHEN n_obs % 5 = 0 THEN NULL WHEN n_obs % 7 = 0 THEN 2e6 ELSE score END AS value, n_obs, 4 AS min_obs FROM sc)
SELECT window_id, indicator_id, engine, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'missing' END, CASE WHEN n_obs < min_obs THEN 'too_few' END, CASE WHEN coalesce(abs(value) > 1e6, false) THEN 'extreme' END], lambda x: x IS NOT NULL), ',') AS reasons, round(greatest(1 - (CASE WHEN value IS NULL THEN 1.0 ELSE 0 END + CASE WHEN n_obs < min_obs THEN 0.5 ELSE 0 END + CASE WHEN coalesce(abs(value) > 1e6, false) THEN 0.3 ELSE 0 END), 0), 6)::DOUBLE AS validity FROM o""")
def output_validation(spark, sf_dir):
    return rounded(policy.validate_outputs(_outputs(spark, sf_dir)).select("window_id", "indicator_id", "engine", F.array_join("reasons", ",").alias("reasons"), "validity"))


def _outputs(spark, sf_dir):
    value = F.when(F.col("n_obs") % 5 == 0, F.lit(None).cast("double")).when(F.col("n_obs") % 7 == 0, 2e6).otherwise(F.col("score"))
    return _scores(spark, sf_dir).withColumn("value", value).withColumn("min_obs", F.lit(4))


@query(f"""WITH {SC}, o AS (SELECT window_id, greatest(1 - (CASE WHEN n_obs % 5 = 0 THEN 1.0 ELSE 0 END + CASE WHEN n_obs < 4 THEN 0.5 ELSE 0 END + CASE WHEN n_obs % 5 <> 0 AND n_obs % 7 = 0 THEN 0.3 ELSE 0 END), 0) AS v, score AS confidence FROM sc)
SELECT window_id, count(*) AS n_outputs, CAST(sum((v >= 0.8)::INT) AS BIGINT) AS n_valid, round(avg(v), 6) AS mean_validity, round(avg(v) * avg(confidence), 6) AS effective_confidence FROM o GROUP BY 1""")
def effective_confidence(spark, sf_dir):
    return rounded(policy.effective_confidence(policy.validate_outputs(_outputs(spark, sf_dir)).withColumn("confidence", F.col("score"))))


@query(f"WITH {SC1} SELECT indicator_id, engine, round(least(CASE WHEN score > 0.4 THEN 1.0 ELSE 0 END * CASE WHEN engine < 'H' THEN 1.0 ELSE 0.25 END * score * 0.9 * 0.8, 0.25), 6) AS weight FROM s1")
def contribution_weights(spark, sf_dir):
    rows = _scores1(spark, sf_dir).withColumn("gate_pass", F.col("score") > 0.4).withColumn("null_pass", F.col("engine") < "H").withColumn("stability", F.col("score")).withColumn("benchmark_score", F.lit(0.9)).withColumn("domain_fit", F.lit(0.8))
    return rounded(policy.contribution_weight(rows).select("indicator_id", "engine", "weight"))


@query(f"WITH {SC}, b AS (SELECT indicator_id, engine, score AS base, score * (1 + 0.1 * window_id) AS varied FROM sc) SELECT indicator_id, engine, round(exp(-2 * avg(abs(varied - base) / (abs(base) + 1e-10))), 6) AS stability, count(*) AS n, exp(-2 * avg(abs(varied - base) / (abs(base) + 1e-10))) < 0.5 AS sensitive FROM b GROUP BY 1, 2")
def metric_sensitivity(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("indicator_id", "engine", F.col("score").alias("base"), (F.col("score") * (1 + 0.1 * F.col("window_id"))).alias("varied"))
    return rounded(policy.metric_sensitivity(rows))


@query(f"WITH {SC1.replace('round(avg(score), 9) AS score', 'round(avg(score) + 0.2, 9) AS score')} SELECT a.indicator_id, a.engine AS engine_1, b.engine AS engine_2, round(a.score, 6) AS x, round(b.score, 6) AS y FROM s1 a JOIN s1 b ON a.indicator_id = b.indicator_id AND (a.engine, b.engine) IN (('BUILDING', 'MACHINERY'), ('HOUSEHOLD', 'FURNITURE')) WHERE a.score > 0.6 AND b.score > 0.6")
def engine_contradictions(spark, sf_dir):
    return rounded(policy.contradictions(_scores(spark, sf_dir).groupBy("indicator_id", "engine").agg(F.round(F.avg("score") + 0.2, 9).alias("score")), (("BUILDING", "MACHINERY"), ("HOUSEHOLD", "FURNITURE"))))


@query(f"WITH {NATION_MONTHLY}, l AS (SELECT indicator_id, value, lag(value) OVER (PARTITION BY indicator_id ORDER BY date) AS b FROM nation_monthly), g AS (SELECT indicator_id, covar_samp(value, b) / nullif(stddev_samp(CASE WHEN b IS NOT NULL THEN value END) * stddev_samp(b), 0) AS r FROM l GROUP BY 1) SELECT indicator_id, round(r, 6) AS residual_acf1, coalesce(abs(r) > 0.1, false) AS structured FROM g")
def residual_checks(spark, sf_dir):
    return rounded(policy.residual_checks(nation_monthly(spark, sf_dir), limit=0.1))


@query(f"WITH {SC1}, f AS (SELECT indicator_id, engine AS kind FROM s1 WHERE score < 0.45) SELECT indicator_id, count(*) AS n_findings, array_to_string(list_sort(list(kind)), ',') AS kinds, CASE WHEN count(*) >= 3 THEN 'escalate' WHEN count(*) = 2 THEN 'review' ELSE 'watch' END AS level FROM f GROUP BY 1")
def escalations(spark, sf_dir):
    got = policy.escalations(_scores1(spark, sf_dir).where("score < 0.45").select("indicator_id", F.col("engine").alias("kind")))
    return got.withColumn("kinds", F.array_join("kinds", ","))


@query(f"""WITH {SC1}, cl AS (SELECT DISTINCT indicator_id, CASE CAST(indicator_id AS INTEGER) % 3 WHEN 0 THEN 'latent_flow' WHEN 1 THEN 'coupled_oscillator' ELSE 'reflexive_stochastic' END AS dominant_geometry FROM s1), ds AS (SELECT indicator_id, CASE engine WHEN 'BUILDING' THEN 'trend_r_squared' WHEN 'MACHINERY' THEN 'periodicity' ELSE 'volatility_clustering' END AS dimension, score - 0.2 AS value FROM s1 WHERE engine IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
rl(dominant_geometry, dimension, least) AS (VALUES ('latent_flow', 'trend_r_squared', 0.3), ('coupled_oscillator', 'periodicity', 0.3), ('reflexive_stochastic', 'volatility_clustering', 0.2))
SELECT cl.indicator_id, cl.dominant_geometry, rl.dimension, round(ds.value, 6) AS value, rl.least::DOUBLE AS least FROM cl JOIN rl USING (dominant_geometry) LEFT JOIN ds ON ds.indicator_id = cl.indicator_id AND ds.dimension = rl.dimension WHERE ds.value IS NULL OR ds.value < rl.least""")
def missing_features(spark, sf_dir):
    s = _scores1(spark, sf_dir)
    k = F.col("indicator_id").cast("int") % 3
    classes = s.select("indicator_id").distinct().withColumn("dominant_geometry", F.when(k == 0, "latent_flow").when(k == 1, "coupled_oscillator").otherwise("reflexive_stochastic"))
    d = s.where(F.col("engine").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).select("indicator_id", F.when(F.col("engine") == "BUILDING", "trend_r_squared").when(F.col("engine") == "MACHINERY", "periodicity").otherwise("volatility_clustering").alias("dimension"), (F.col("score") - 0.2).alias("value"))
    return rounded(policy.missing_features(classes, d))


@query(f"WITH {NATION_MONTHLY} SELECT * FROM nation_monthly WHERE indicator_id IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def allowlist(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("indicator_id"))
    return policy.allowed(nation_monthly(spark, sf_dir), ids).select("indicator_id", "date", "value")


@query(f"""WITH {SC}, c AS (SELECT window_id, indicator_id, engine, score AS capped_weight, n_obs % 4 <> 0 AS contributing FROM sc), on1 AS (SELECT *, CASE WHEN contributing THEN capped_weight ELSE 0 END AS w FROM c), t AS (SELECT *, sum(w) OVER p AS tt, sum(contributing::INT) OVER p AS nn, row_number() OVER (PARTITION BY window_id, indicator_id ORDER BY contributing::INT DESC, w DESC, engine) AS k FROM on1 WINDOW p AS (PARTITION BY window_id, indicator_id)),
u AS (SELECT *, max(CASE WHEN k = 1 THEN w END) OVER p AS t1, max(CASE WHEN k = 2 AND contributing THEN w END) OVER p AS t2 FROM t WINDOW p AS (PARTITION BY window_id, indicator_id)), s AS (SELECT *, CASE WHEN contributing AND nn >= 2 THEN CASE WHEN k = 1 THEN t2 ELSE t1 END * w / nullif(tt * nullif(tt - w, 0), 0) END AS shift FROM u)
SELECT window_id, indicator_id, engine, contributing, round(capped_weight, 9) AS capped_weight, round(CASE WHEN contributing THEN w / nullif(tt, 0) END, 6) AS normalized_weight, round(shift, 6) AS shift, coalesce(shift > 0.2, false) AS vulnerable, round(coalesce(max(shift) OVER p, 0), 6) AS max_weight_shift, nn >= 2 AND max(coalesce(shift > 0.2, false)::INT) OVER p = 0 AS stable FROM s WINDOW p AS (PARTITION BY window_id, indicator_id)""")
def consensus_report(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("window_id", "indicator_id", "engine", F.col("score").alias("capped_weight"), (F.col("n_obs") % 4 != 0).alias("contributing"))
    return rounded(vectors.consensus_report(rows, ("window_id", "indicator_id")), 6, capped_weight=9)


# ---- state vectors


VECS = "ve AS (SELECT CAST(label AS VARCHAR) AS entity, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS window_id, list_transform(embedding[1:7], lambda x: x::DOUBLE) AS vector FROM embeddings), vl AS (SELECT *, lag(vector) OVER (PARTITION BY entity ORDER BY window_id) AS b FROM ve), vm AS (SELECT entity, window_id, vector, CASE WHEN b IS NOT NULL THEN list_transform(range(1, 8), lambda i: vector[i] - b[i]) END AS velocity FROM vl), mv AS (SELECT *, sqrt(list_sum(list_transform(velocity, lambda x: x * x))) AS displacement FROM vm)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("entity"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("window_id"), F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("vector"))


def _moved(spark, sf_dir):
    return vectors.velocities(_vectors(spark, sf_dir))


@query(f"""WITH {VECS}, g AS (SELECT entity, count(*) AS n, coalesce(sum(displacement), 0) AS td, coalesce(avg(displacement), 0) AS av, coalesce(max(displacement), 0) AS mx, arg_min(vector, window_id) AS a, arg_max(vector, window_id) AS z FROM mv GROUP BY 1)
SELECT entity, n, round(td, 5) AS total_distance, round(av, 6) AS avg_step_size, round(mx, 6) AS max_step_size, round(sqrt(list_sum(list_transform(range(1, 8), lambda i: power(a[i] - z[i], 2)))), 6) AS net_displacement FROM g""")
def trajectory_stats(spark, sf_dir):
    return rounded(vectors.trajectory_stats(_vectors(spark, sf_dir)), 6, total_distance=5)


@query(f"""WITH {VECS}, w AS (SELECT entity, window_id, DATE '2020-01-01' + window_id * 30 - CASE WHEN window_id % 40 = 39 THEN 90 ELSE 0 END AS ws, displacement, CASE WHEN (window_id * 7) % 20 = 0 THEN 0.2 ELSE 0.9 END AS completeness FROM mv), l AS (SELECT *, (displacement - avg(displacement) OVER p) / nullif(stddev_pop(displacement) OVER p, 0) AS z, (ws < lag(ws) OVER (PARTITION BY entity ORDER BY window_id))::INT AS back FROM w WINDOW p AS (PARTITION BY entity)),
g AS (SELECT entity, count(*) AS n_windows, coalesce(max(back), 0) = 0 AS ok, avg(displacement) AS m, stddev_pop(displacement) AS sd, CASE WHEN count(displacement) >= 3 THEN sum(coalesce(abs(z) > 2, false)::INT) ELSE 0 END AS nd, CAST(sum((completeness < 0.3)::INT) AS BIGINT) AS ns FROM l GROUP BY 1),
s AS (SELECT *, round(least(greatest(1 - 0.1 * nd - CASE WHEN n_windows < 3 THEN 0.4 ELSE 0 END - CASE WHEN NOT ok THEN 0.3 ELSE 0 END - CASE WHEN ns > 2 THEN 0.15 ELSE 0 END, 0), 1), 9) AS score FROM g)
SELECT entity, n_windows, ok AS is_chronological, round(m, 6) AS mean_displacement, round(sd, 6) AS std_displacement, CAST(nd AS BIGINT) AS n_discontinuities, ns AS n_sparse, array_to_string(list_filter([CASE WHEN n_windows < 3 THEN 'too_few_windows' END, CASE WHEN NOT ok THEN 'not_chronological' END, CASE WHEN nd > 0 THEN 'discontinuities' END, CASE WHEN ns > 2 THEN 'sparse_windows' END], lambda x: x IS NOT NULL), ',') AS issues, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'valid' WHEN score >= 0.5 THEN 'marginal' ELSE 'invalid' END AS status FROM s""")
def trajectory_coherence(spark, sf_dir):
    k = F.col("window_id")
    start = F.date_add(F.lit("2020-01-01").cast("date"), k * 30 - F.when(k % 40 == 39, 90).otherwise(0))
    rows = _moved(spark, sf_dir).withColumn("window_start", start).withColumn("completeness", F.when((k * 7) % 20 == 0, 0.2).otherwise(0.9))
    return rounded(vectors.trajectory_coherence(rows, limit=2.0).withColumn("issues", F.array_join("issues", ",")))


@query("""WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE round((s_acctbal + 1000) / 11000, 8) END AS resistance, CAST(s_suppkey % 8 AS INTEGER) AS n_windows, CASE s_nationkey % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'climate' ELSE 'other' END AS domain FROM supplier),
b AS (SELECT *, CASE domain WHEN 'finance' THEN 0.2 WHEN 'climate' THEN 0.6 ELSE 0.1 END AS lo, CASE domain WHEN 'finance' THEN 0.9 WHEN 'climate' THEN 0.95 ELSE 0.95 END AS hi, CASE WHEN n_windows >= 5 THEN 0.9 WHEN n_windows >= 3 THEN 0.6 ELSE 0.3 END AS confidence, CASE WHEN resistance IS NOT NULL AND count(resistance) OVER (PARTITION BY domain) > 5 THEN cume_dist() OVER (PARTITION BY domain, resistance IS NOT NULL ORDER BY resistance) END AS pc FROM r),
s AS (SELECT *, resistance BETWEEN lo AND hi AS ib, CASE WHEN resistance IS NULL THEN 0 ELSE round(confidence - CASE WHEN NOT (resistance BETWEEN lo AND hi) THEN 0.2 ELSE 0 END, 9) END AS score FROM b)
SELECT entity, domain, round(resistance, 6) AS resistance, n_windows, ib AS in_bounds, confidence::DOUBLE AS confidence, round(pc, 6) AS percentile, CASE WHEN pc > 0.9 THEN 'very_rigid' WHEN pc > 0.7 THEN 'rigid' WHEN pc > 0.3 THEN 'moderate' WHEN pc > 0.1 THEN 'fluid' WHEN pc IS NOT NULL THEN 'very_fluid' END AS class, round(score, 6)::DOUBLE AS score, CASE WHEN resistance IS NULL THEN 'invalid' WHEN score >= 0.7 THEN 'valid' WHEN score >= 0.4 THEN 'marginal' ELSE 'invalid' END AS status FROM s""")
def resistance_calibration(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").cast("string").alias("entity"), F.when(F.col("s_suppkey") % 11 != 0, F.round((F.col("s_acctbal") + 1000) / 11000, 8)).alias("resistance"), (F.col("s_suppkey") % 8).cast("int").alias("n_windows"), F.when(F.col("s_nationkey") % 3 == 0, "finance").when(F.col("s_nationkey") % 3 == 1, "climate").otherwise("other").alias("domain"))
    return rounded(vectors.resistance_calibration(rows).drop("issues"))


@query(f"""WITH {VECS}, u AS (SELECT window_id, entity, velocity, displacement AS n, unnest(range(1, 8)) AS i FROM mv WHERE velocity IS NOT NULL), e AS (SELECT window_id, entity, i, velocity[i] AS v, coalesce(velocity[i] / nullif(n, 0), 0) AS un FROM u), m AS (SELECT *, avg(v) OVER (PARTITION BY window_id, i) AS m FROM e), o AS (SELECT window_id, entity, sqrt(sum((v - m) * (v - m))) AS off FROM m GROUP BY 1, 2), oo AS (SELECT window_id, avg(off) AS vd, count(*) AS n FROM o GROUP BY 1), p AS (SELECT window_id, i, avg(v) AS m, avg(un) AS un FROM e GROUP BY 1, 2), pp AS (SELECT window_id, sqrt(sum(m * m)) AS mvel, sqrt(sum(un * un)) AS co FROM p GROUP BY 1)
SELECT window_id, round(mvel, 6) AS mean_velocity, round(co, 6) AS coherence, round(vd, 6) AS velocity_dispersion, n AS n_indicators, CASE WHEN co > 0.7 THEN 'coherent_drift' WHEN co < 0.3 THEN 'dispersive' ELSE 'mixed' END AS kind FROM pp JOIN oo USING (window_id) WHERE n >= 5""")
def deformation(spark, sf_dir):
    return rounded(vectors.deformation(_moved(spark, sf_dir)))


@query(f"WITH {VECS}, z AS (SELECT window_id, entity, displacement, (displacement - avg(displacement) OVER w) / nullif(stddev_pop(displacement) OVER w, 0) AS z FROM mv WHERE displacement IS NOT NULL WINDOW w AS (PARTITION BY window_id)) SELECT window_id, entity, round(displacement, 6) AS displacement, round(z, 5) AS z, CASE WHEN z > 0 THEN 'fast_mover' ELSE 'anchored' END AS kind FROM z WHERE abs(z) > 1.5")
def deformation_outliers(spark, sf_dir):
    return rounded(vectors.deformation_outliers(_moved(spark, sf_dir), limit=1.5), 6, z=5)


@query(f"WITH {VECS} SELECT entity, count(displacement) AS n, round(var_pop(displacement * 100), 5) AS variance, round(avg(displacement * 100), 5) AS mean FROM mv GROUP BY 1 HAVING count(displacement) >= 3 AND var_pop(displacement * 100) > 2 * avg(displacement * 100)")
def stress_regions(spark, sf_dir):
    return rounded(vectors.stress_regions(_moved(spark, sf_dir).withColumn("displacement", F.col("displacement") * 100)), 5)


ANOMALIES = "an AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, CAST(c_custkey % 60 AS INTEGER) AS window_id, c_acctbal / 2500 AS z FROM customer WHERE c_acctbal > 5500 AND c_custkey % 7 = 0)"


def _anomalies(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 5500 AND c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("entity"), (F.col("c_custkey") % 60).cast("int").alias("window_id"), (F.col("c_acctbal") / 2500).alias("z"))


@query(f"""WITH {ANOMALIES}, p AS (SELECT *, count(*) OVER (PARTITION BY window_id) - 1 AS n FROM an), c AS (SELECT entity, window_id, n, 'systematic_factor' AS candidate, least(0.8, 0.3 + 0.1 * n) AS confidence FROM p WHERE n >= 3 UNION ALL SELECT entity, window_id, n, 'idiosyncratic_factor', 0.4 FROM p WHERE n = 0 UNION ALL SELECT entity, window_id, n, 'extreme_event', 0.6 FROM p WHERE z > 3 UNION ALL SELECT entity, window_id, n, 'event: outage', 0.5 FROM p WHERE window_id < 20)
SELECT entity, window_id, n AS n_peers, candidate, round(confidence, 6)::DOUBLE AS confidence, CAST(row_number() OVER (PARTITION BY entity, window_id ORDER BY confidence DESC, candidate) AS INTEGER) AS place FROM c""")
def anomaly_attribution(spark, sf_dir):
    events = spark.range(20).select(F.col("id").cast("int").alias("window_id"), F.lit("outage").alias("event"))
    return rounded(vectors.attribute_anomalies(_anomalies(spark, sf_dir), events))


@query(f"WITH {ANOMALIES} SELECT window_id, count(*) AS n_anomalies, CASE WHEN count(*) >= 5 THEN 'persistent_factor' WHEN count(*) >= 2 THEN 'episodic_factor' ELSE 'artifact_or_rare_event' END AS hypothesis, CASE WHEN count(*) >= 5 THEN 0.7 WHEN count(*) >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM an GROUP BY 1")
def hidden_mass_hypothesis(spark, sf_dir):
    return vectors.hidden_mass_hypothesis(_anomalies(spark, sf_dir), ("window_id",))


@query(f"""WITH {VECS}, c AS (SELECT CAST(entity AS INTEGER) % 2 AS cohort_id, entity, window_id, displacement, (sum(displacement) OVER w - displacement) / nullif(count(displacement) OVER w - 1, 0) AS rest FROM mv WINDOW w AS (PARTITION BY CAST(entity AS INTEGER) % 2, window_id)), g AS (SELECT cohort_id, entity, covar_samp(displacement, rest) / nullif(stddev_samp(CASE WHEN rest IS NOT NULL THEN displacement END) * stddev_samp(rest), 0) AS r, count(rest) AS n FROM c WHERE displacement IS NOT NULL GROUP BY 1, 2)
SELECT CAST(cohort_id AS INTEGER) AS cohort_id, entity, round(r, 6) AS velocity_corr, n, coalesce(r < 0.3, false) AS apart FROM g""")
def cohort_velocity(spark, sf_dir):
    return rounded(vectors.cohort_velocity(_moved(spark, sf_dir).withColumn("cohort_id", F.col("entity").cast("int") % 2)))


# ---- residual physics


BASIS = np.array([[0.5, 0.5, 0.5, 0.5, 0, 0, 0], [0.5, -0.5, 0.5, -0.5, 0, 0, 0]])
PRECISION = np.diag(np.arange(1.0, 8.0)) + 0.25 * (np.eye(7, k=1) + np.eye(7, k=-1))


def _dot(row, v: str) -> str:
    return "(" + " + ".join(f"{float(x)!r} * {v}[{j + 1}]" for j, x in enumerate(row) if x) + ")"


def _quad(m, v: str) -> str:
    return "(" + " + ".join(f"{float(x)!r} * {v}[{i + 1}] * {v}[{j + 1}]" for i, row in enumerate(m) for j, x in enumerate(row) if x) + ")"


_RESIDUAL = "[" + ", ".join(f"velocity[{i + 1}]" + (f" - {_dot(row, 'velocity')}" if any(row) else "") for i, row in enumerate(BASIS.T @ BASIS)) + "]"
STATES = f"""{VECS}, pr AS (SELECT *, {_RESIDUAL} AS r, (0.3 + 0.05 * CAST(entity AS INTEGER)) / (1 + CAST(entity AS INTEGER) % 3) AS mass FROM mv WHERE velocity IS NOT NULL),
ps AS (SELECT *, sqrt(greatest({_quad(PRECISION, 'r')}, 0)) AS residual, sqrt(list_dot_product(r, r)) AS re, {_quad(PRECISION, 'vector')} AS self_influence, [{_dot(BASIS[0], 'velocity')}, {_dot(BASIS[1], 'velocity')}] AS pv, {_quad(PRECISION, 'velocity')} AS v2 FROM pr),
px AS (SELECT entity, window_id, pv, residual, re AS residual_euclidean, residual * mass AS hidden_mass, residual > 0.9 AS significant, self_influence, 0.5 * mass * v2 AS kinetic_energy, residual / 0.5 AS constraint_tension, CASE WHEN residual > 0 THEN re / greatest(residual, 1e-10) ELSE 1.0 END AS amplification FROM ps)"""


def _states(spark, sf_dir):
    k = F.col("entity").cast("int")
    rows = _vectors(spark, sf_dir).withColumn("importance", 0.3 + 0.05 * k).withColumn("dof", (1 + k % 3).cast("double")).withColumn("expected_volatility", F.lit(0.5))
    return vectors.physics(rows, BASIS.tolist(), PRECISION.tolist(), threshold=0.9)


@query(f"WITH {STATES} SELECT entity, window_id, round(residual, 6) AS residual, round(residual_euclidean, 6) AS residual_euclidean, round(hidden_mass, 6) AS hidden_mass, significant, round(self_influence, 6) AS self_influence, round(kinetic_energy, 6) AS kinetic_energy, round(constraint_tension, 6) AS constraint_tension, round(amplification, 6) AS amplification FROM px")
def residual_physics(spark, sf_dir):
    return rounded(_states(spark, sf_dir).select("entity", "window_id", "residual", "residual_euclidean", "hidden_mass", "significant", "self_influence", "kinetic_energy", "constraint_tension", "amplification"))


RESIST = f"""{STATES}, pl AS (SELECT *, lag(pv) OVER l AS pb, sqrt(list_dot_product(pv, pv)) AS sp, row_number() OVER l AS rn FROM px WINDOW l AS (PARTITION BY entity ORDER BY window_id)), pc AS (SELECT *, CASE WHEN sp > 1e-10 AND sqrt(list_dot_product(pb, pb)) > 1e-10 THEN list_dot_product(pv, pb) / (sp * sqrt(list_dot_product(pb, pb))) END AS cs FROM pl),
pf AS (SELECT *, coalesce(avg((cs + 1) / 2) OVER (PARTITION BY entity ORDER BY window_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), 0.5) AS di, CASE WHEN avg(sp) OVER f > 1e-10 THEN 1 / (1 + stddev_pop(sp) OVER f / avg(sp) OVER f) ELSE 0.5 END AS ma, 1 / (1 + var_pop(hidden_mass) OVER f) AS sm FROM pc WINDOW f AS (PARTITION BY entity ORDER BY window_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
pg AS (SELECT *, CASE WHEN rn > 5 THEN least(greatest(0.4 * di + 0.3 * ma + 0.3 * sm, 0), 1) ELSE 0.5 END AS resistance FROM pf), ph AS (SELECT *, CASE WHEN resistance > 0.5 THEN CASE WHEN self_influence < 0.4 THEN 'rigid' ELSE 'stable' END ELSE CASE WHEN self_influence < 0.4 THEN 'fluid' ELSE 'volatile' END END AS stability_class FROM pg)"""


def _resisting(spark, sf_dir):
    return vectors.resistance(_states(spark, sf_dir), 0.4)


@query(f"WITH {RESIST} SELECT entity, window_id, round(resistance, 6) AS resistance, stability_class FROM ph")
def emergent_resistance(spark, sf_dir):
    return rounded(_resisting(spark, sf_dir).select("entity", "window_id", "resistance", "stability_class"))


@query(f"""WITH {RESIST}, a AS (SELECT *, hidden_mass - avg(hidden_mass) OVER (PARTITION BY entity) AS c, sign(pv[1]) AS sg FROM ph), b AS (SELECT *, lead(c) OVER l AS nc, (sg <> lag(sg) OVER l)::INT AS tu FROM a WINDOW l AS (PARTITION BY entity ORDER BY window_id)), d AS (SELECT *, sum(coalesce(tu, 0)) OVER (PARTITION BY entity ORDER BY window_id) AS si FROM b), e AS (SELECT *, max(si) OVER (PARTITION BY entity) AS la FROM d)
SELECT entity, count(*) AS n_observations, round(sum(hidden_mass), 5) AS total_hidden_mass, CAST(sum(significant::INT) AS BIGINT) AS hidden_mass_events, round(coalesce(avg(cs), 0), 6) AS direction_consistency, CAST(coalesce(sum(tu), 0) AS BIGINT) AS regime_transitions, CAST(sum((si = la)::INT) AS BIGINT) AS current_regime_duration, round(CASE WHEN count(*) > 3 THEN coalesce(sum(c * nc) / nullif(sum(c * c), 0), 0) ELSE 0 END, 6) AS hidden_mass_persistence FROM e GROUP BY 1""")
def trajectory_analysis(spark, sf_dir):
    return rounded(vectors.trajectory_analysis(_states(spark, sf_dir)), 6, total_hidden_mass=5)


@query(f"WITH {STATES}, z AS (SELECT *, (hidden_mass - avg(hidden_mass) OVER w) / nullif(stddev_pop(hidden_mass) OVER w, 0) AS z, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY entity)) SELECT entity, window_id, round(hidden_mass, 6) AS hidden_mass, round(z, 5) AS z FROM z WHERE n >= 5 AND z > 1.5")
def hidden_mass_events(spark, sf_dir):
    return rounded(vectors.hidden_mass_events(_states(spark, sf_dir), 1.5).select("entity", "window_id", "hidden_mass", "z"), 6, z=5)


@query(f"WITH {RESIST} SELECT stability_class, count(*) AS n_states, count(DISTINCT entity) AS n_entities, round(sum(hidden_mass), 4) AS total_hidden_mass, round(avg(hidden_mass), 6) AS mean_hidden_mass, round(stddev_pop(hidden_mass), 6) AS std_hidden_mass, round(avg(amplification), 6) AS mean_amplification FROM ph GROUP BY ROLLUP (stability_class)")
def system_deformation(spark, sf_dir):
    return rounded(vectors.system_deformation(_resisting(spark, sf_dir)), 6, total_hidden_mass=4)


# ---- assembly and validation


_KEYS = [(e, k) for e, k, _ in vectors.FRAME]


@query(f"""WITH {TALL}, ky(dimension, engine, output_key, lg) AS (VALUES {', '.join(f"({i + 1}, '{e}', '{k}', {str(i == 8).lower()})" for i, (e, k) in enumerate(_KEYS))}), o AS (SELECT indicator_id, window_id, ky.dimension, CASE WHEN ky.dimension % 3 = 0 AND window_id % 2 = 0 THEN NULL WHEN lg AND abs(value) > 0 THEN ln(abs(value)) ELSE abs(value) END AS value, 1 - window_id / 100.0::DOUBLE AS cf FROM tv JOIN ky ON ky.dimension = tv.dimension + 3),
g AS (SELECT indicator_id, window_id, list(value ORDER BY dimension) AS vs, list(dimension ORDER BY dimension) AS ds, count(*) AS n, sum(cf) AS w FROM o WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT indicator_id, window_id, array_to_string(list_transform(range(1, 11), lambda i: CAST(CAST(round(coalesce(vs[list_position(ds, i)], 0) * 10000) AS BIGINT) AS VARCHAR)), ',') AS vector, round(n / 10, 6) AS coverage, CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS effective_confidence FROM g""")
def vector_assembly(spark, sf_dir):
    t = _tall(spark, sf_dir)
    names = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(k).alias("k")) for e, k in _KEYS])
    at = F.col("dimension") + 2
    o = t.select("indicator_id", "window_id", F.get(names, at)["e"].alias("engine"), F.get(names, at)["k"].alias("output_key"), F.when(((F.col("dimension") + 3) % 3 != 0) | (F.col("window_id") % 2 != 0), F.abs("value")).alias("value"), (1 - F.col("window_id") / 100.0).alias("confidence"))
    got = vectors.assemble(o)
    return rounded(got.withColumn("vector", F.array_join(F.transform("vector", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")))


@query(f"""WITH {TALL}, c AS (SELECT indicator_id AS entity, count(DISTINCT dimension) / 7 AS co, avg(CASE WHEN window_id % 9 = 0 THEN 1.0 ELSE 0 END) AS na, avg(CASE WHEN window_id % 9 = 0 THEN NULL ELSE (abs(value * 3000) > 1000)::INT END) AS ex FROM tv GROUP BY 1), s AS (SELECT *, co * (1 - na) * (1 - coalesce(ex, 0)) AS sc FROM c)
SELECT entity, round(co, 6) AS completeness, round(na, 6) AS nan_ratio, round(ex, 6) AS extreme_ratio, round(sc, 6) AS score, CASE WHEN sc >= 0.8 THEN 'valid' WHEN sc >= 0.5 THEN 'marginal' ELSE 'invalid' END AS status FROM s""")
def vector_validation(spark, sf_dir):
    t = _tall(spark, sf_dir).select(F.col("indicator_id").alias("entity"), F.col("dimension").alias("component"), F.when(F.col("window_id") % 9 != 0, F.col("value") * 3000).alias("value"))
    return rounded(policy.validate_vectors(t))


@query(f"WITH {TALL}, m AS (SELECT indicator_id AS entity, dimension AS component, sqrt(sum(value * value)) AS m FROM tv WHERE dimension <= 4 GROUP BY 1, 2), s AS (SELECT *, m / nullif(sum(m) OVER (PARTITION BY entity), 0) AS sh FROM m) SELECT entity, component, round(m, 6) AS magnitude, round(sh, 6) AS share, CASE WHEN sh > 0.30 THEN 'dominant' WHEN sh < 0.05 THEN 'negligible' ELSE 'balanced' END AS role FROM s")
def component_balance(spark, sf_dir):
    t = _tall(spark, sf_dir).where("dimension <= 4").select(F.col("indicator_id").alias("entity"), F.col("dimension").alias("component"), "value")
    return rounded(policy.component_balance(t))


@query(f"""WITH {WCORR}, s AS (SELECT window_id, avg(abs(corr)) AS m, stddev_pop(corr) AS dispersion, avg((abs(corr) > 0.05)::INT) AS density, [max(abs(corr)), avg(abs(corr)), min(abs(corr))] AS sh FROM wc GROUP BY 1), d AS (SELECT *, CAST(3 + window_id % 5 AS INTEGER) AS n, 1.0 + window_id % 3 AS ed, sqrt(list_sum(list_transform(sh, lambda x: power(x - list_sum(sh) / 3, 2))) / 3) AS sp, sh[1] / nullif(sh[2], 0) AS gap FROM s),
i AS (SELECT *, ed / n AS ra, [CASE WHEN n < 5 THEN 'too_few_indicators' END, CASE WHEN ed / n > 0.8 THEN 'dimension_too_high' END, CASE WHEN ed / n < 0.1 THEN 'dimension_too_low' END, CASE WHEN sp < 0.01 THEN 'degenerate_spectrum' END, CASE WHEN sh[2] > 0 AND gap < 1.5 THEN 'weak_first_gap' END, CASE WHEN density < 0.1 THEN 'sparse_network' END, CASE WHEN density > 0.9 THEN 'dense_network' END, CASE WHEN dispersion < 0.01 THEN 'uniform_correlations' END] AS ix FROM d),
k AS (SELECT *, round(least(greatest(1 - list_sum(list_transform(list_zip(ix, [0.3, 0.2, 0.1, 0.2, 0.1, 0.1, 0.0, 0.15]), lambda z: CASE WHEN z[1] IS NULL THEN 0 ELSE z[2] END)), 0), 1), 9) AS score FROM i)
SELECT window_id, round(ra, 6)::DOUBLE AS dimension_ratio, round(gap, 5) AS pc_gap, array_to_string(list_filter(ix, lambda x: x IS NOT NULL), ',') AS issues, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'valid' WHEN score >= 0.5 THEN 'marginal' ELSE 'invalid' END AS status FROM k""")
def geometry_validation(spark, sf_dir):
    c, _ = yearly_corr(spark, sf_dir)
    r = F.abs("corr")
    s = c.groupBy("window_id").agg(F.stddev_pop("corr").alias("dispersion"), F.avg((r > 0.05).cast("double")).alias("density"), F.array(F.max(r), F.avg(r), F.min(r)).alias("shares"))
    s = s.withColumn("n_indicators", 3 + F.col("window_id") % 5).withColumn("effective_dimension", 1.0 + F.col("window_id") % 3)
    return rounded(vectors.validate_geometry(s).select("window_id", "dimension_ratio", "pc_gap", F.array_join("issues", ",").alias("issues"), "score", "status"), 6, pc_gap=5)


@query(f"""WITH {TALL}, p AS (SELECT window_id, indicator_id, list(value ORDER BY dimension) AS v FROM tv GROUP BY 1, 2), q AS (SELECT window_id, indicator_id, abs(v[4] * 8) AS iso, abs(v[5]) AS cd, v[1:3] AS ld, CAST(window_id % 3 AS INTEGER) AS nn FROM p), z AS (SELECT *, (cd - avg(cd) OVER w) / nullif(stddev_pop(cd) OVER w, 0) AS cz, len(list_filter(ld, lambda x: abs(x) > 0.1)) AS nm FROM q WINDOW w AS (PARTITION BY window_id)),
s AS (SELECT *, round(least(greatest(1 - CASE WHEN iso > 0.95 THEN 0.2 ELSE 0 END - CASE WHEN iso < 0.05 THEN 0.1 ELSE 0 END - CASE WHEN coalesce(abs(cz) > 3, false) THEN 0.2 ELSE 0 END - CASE WHEN nm < 2 THEN 0.15 ELSE 0 END - CASE WHEN nn = 0 AND iso < 0.9 THEN 0.1 ELSE 0 END, 0), 1), 9) AS score FROM z)
SELECT window_id, indicator_id, round(cz, 5) AS centroid_z, CAST(nm AS INTEGER) AS n_meaningful, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'valid' WHEN score >= 0.5 THEN 'marginal' ELSE 'invalid' END AS status FROM s""")
def position_validation(spark, sf_dir):
    p = _tall(spark, sf_dir).groupBy("window_id", "indicator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "value"))), lambda s: s["value"]).alias("v"))
    q = p.select("window_id", "indicator_id", F.abs(F.get("v", F.lit(3)) * 8).alias("isolation"), F.abs(F.get("v", F.lit(4))).alias("centroid_distance"), F.slice("v", 1, 3).alias("loadings"), (F.col("window_id") % 3).alias("n_neighbors"))
    return rounded(vectors.validate_positions(q).select("window_id", "indicator_id", "centroid_z", "n_meaningful", "score", "status"), 6, centroid_z=5)


LIMITS = "lm AS (SELECT CAST(s_nationkey AS VARCHAR) AS window_id, CAST(s_suppkey AS VARCHAR) AS indicator_id, (s_suppkey % 25) / 2.0::DOUBLE AS dof, s_acctbal AS volatility, s_acctbal / 8000 AS mean_reversion, (s_suppkey % 10) / 10.0::DOUBLE AS centrality FROM supplier)"


def _limits(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("string").alias("window_id"), F.col("s_suppkey").cast("string").alias("indicator_id"), ((F.col("s_suppkey") % 25) / 2.0).alias("dof"), F.col("s_acctbal").alias("volatility"), (F.col("s_acctbal") / 8000).alias("mean_reversion"), ((F.col("s_suppkey") % 10) / 10.0).alias("centrality"))


@query(f"""WITH {LIMITS}, z AS (SELECT *, CASE WHEN count(volatility) OVER w > 3 THEN (volatility - avg(volatility) OVER w) / nullif(stddev_pop(volatility) OVER w, 0) END AS vz FROM lm WINDOW w AS (PARTITION BY window_id)), s AS (SELECT *, round(least(greatest(1 - CASE WHEN dof < 1 THEN 0.2 ELSE 0 END - CASE WHEN dof > 10 THEN 0.1 ELSE 0 END - CASE WHEN coalesce(abs(vz) > 3, false) THEN 0.15 ELSE 0 END - CASE WHEN NOT (mean_reversion BETWEEN 0 AND 1) THEN 0.1 ELSE 0 END - CASE WHEN centrality > 0.7 AND dof > 5 THEN 0.1 ELSE 0 END, 0), 1), 9) AS score FROM z)
SELECT window_id, indicator_id, round(vz, 5) AS volatility_z, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'valid' WHEN score >= 0.5 THEN 'marginal' ELSE 'invalid' END AS status FROM s""")
def constraint_calibration(spark, sf_dir):
    return rounded(vectors.calibrate_constraints(_limits(spark, sf_dir)).select("window_id", "indicator_id", "volatility_z", "score", "status"), 6, volatility_z=5)


RELEVANT = "rv AS (SELECT CAST(c_nationkey AS VARCHAR) AS window_id, CAST(c_custkey AS VARCHAR) AS indicator_id, (c_custkey % 11) / 10.0::DOUBLE AS sc, (c_custkey % 7) / 6.0::DOUBLE AS ec, (c_custkey % 5) / 4.0::DOUBLE AS iv, (c_custkey % 13)::DOUBLE AS inf, (c_custkey % 4)::DOUBLE AS sen FROM customer), rs AS (SELECT *, least(greatest(0.4 * sc + 0.3 * ec + 0.3 * iv, 0), 1) AS rel, inf / nullif(sen, 0) AS ratio FROM rv)"


def _relevant(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("window_id"), k.cast("string").alias("indicator_id"), ((k % 11) / 10.0).alias("structural_centrality"), ((k % 7) / 6.0).alias("eigenvector_centrality"), ((k % 5) / 4.0).alias("information_value"), (k % 13).cast("double").alias("influence"), (k % 4).cast("double").alias("sensitivity"))
    return vectors.score_relevance(c)


@query(f"WITH {RELEVANT} SELECT window_id, indicator_id, round(rel, 6) AS relevance, CASE WHEN ratio > 5 THEN 'strong_leader' WHEN ratio > 1.5 THEN 'leader' WHEN ratio < 0.2 THEN 'strong_follower' WHEN ratio < 0.67 THEN 'follower' ELSE 'balanced' END AS role, CASE WHEN sc > 0.7 AND ec < 0.2 THEN 'marginal' ELSE 'valid' END AS status FROM rs")
def relevance_scores(spark, sf_dir):
    return rounded(_relevant(spark, sf_dir).select("window_id", "indicator_id", "relevance", "role", "status"))


@query(f"WITH {RELEVANT} SELECT window_id, count(*) AS n_indicators, round(avg(rel), 6) AS mean_relevance, round(stddev_pop(rel), 6) AS std_relevance, round(min(rel), 6) AS min_relevance, round(max(rel), 6) AS max_relevance, round(quantile_cont(rel, 0.5), 6) AS median_relevance, CAST(sum((rel >= 0.7)::INT) AS BIGINT) AS n_high, CAST(sum((rel <= 0.1)::INT) AS BIGINT) AS n_low, array_to_string(list_filter([CASE WHEN stddev_pop(rel) < 0.05 THEN 'little_variation' END, CASE WHEN sum((rel >= 0.7)::INT) = 0 THEN 'none_high' END, CASE WHEN sum((rel <= 0.1)::INT) > 0.5 * count(*) THEN 'mostly_low' END], lambda x: x IS NOT NULL), ',') AS flags FROM rs GROUP BY 1")
def relevance_distribution(spark, sf_dir):
    got = vectors.relevance_distribution(_relevant(spark, sf_dir))
    return rounded(got.withColumn("flags", F.array_join("flags", ",")))


@query(f"""WITH {MOTION}, s AS (SELECT indicator_id AS cohort_id, window_id, distance AS a, n_dims * distance AS b FROM mm), l AS (SELECT *, 1 / (1 + abs(a - lag(a) OVER w)) AS sa, 1 / (1 + abs(b - lag(b) OVER w)) AS sb FROM s WINDOW w AS (PARTITION BY cohort_id ORDER BY window_id)) SELECT cohort_id, window_id, round((sa + sb) / 2, 6) AS stability, (sa + sb) / 2 >= 0.7 AS stable FROM l""")
def geometry_stability(spark, sf_dir):
    m = dynamics.vector_motion(_tall(spark, sf_dir)).select(F.col("indicator_id").alias("cohort_id"), "window_id", F.col("distance").alias("a"), (F.col("n_dims") * F.col("distance")).alias("b"))
    return rounded(policy.geometry_stability(m, ["a", "b"]).select("cohort_id", "window_id", "stability", "stable"))


@query(f"""WITH {STATES}, z AS (SELECT *, (hidden_mass - avg(hidden_mass) OVER w) / nullif(stddev_pop(hidden_mass) OVER w, 0) AS z, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY entity)), h AS (SELECT *, coalesce(z > 1, false) AS hi FROM z), c AS (SELECT *, CASE WHEN hi IS DISTINCT FROM lag(hi) OVER (PARTITION BY entity ORDER BY window_id) THEN 1 ELSE 0 END AS ch FROM h), r AS (SELECT *, sum(ch) OVER (PARTITION BY entity ORDER BY window_id) AS run FROM c)
SELECT entity, min(window_id) AS first, max(window_id) AS last, count(*) AS duration_frames, round(max(hidden_mass), 6) AS peak, round(max(z), 5) AS z, CASE WHEN max(z) > 3 THEN 'extreme' ELSE 'significant' END AS severity FROM r WHERE hi AND n >= 5 GROUP BY entity, run""")
def hidden_mass_episodes(spark, sf_dir):
    return rounded(vectors.hidden_mass_episodes(_states(spark, sf_dir), 1.0), 6, z=5)


TENSION = "te AS (SELECT CAST(c_nationkey % 5 AS INTEGER) AS cohort, CAST(c_custkey % 30 AS INTEGER) AS window_id, avg(c_acctbal) / 10000 AS tension FROM customer GROUP BY 1, 2)"


@query(f"""WITH {TENSION}, d AS (SELECT *, tension - lag(tension) OVER l AS d FROM te WINDOW l AS (PARTITION BY cohort ORDER BY window_id)), k AS (SELECT *, count(d) OVER (PARTITION BY cohort ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k, list(d) OVER (PARTITION BY cohort ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ds FROM d),
w AS (SELECT *, list_reverse(list_filter(ds, lambda x: x IS NOT NULL)) AS r FROM k), m AS (SELECT cohort, window_id, tension, k, CASE WHEN k >= 2 THEN list_sum(list_transform(range(0, k), lambda i: exp(-i / (k - 1)) * r[i + 1])) / list_sum(list_transform(range(0, k), lambda i: exp(-i / (k - 1)))) ELSE 0 END AS mo FROM w)
SELECT cohort, window_id, round(tension, 6) AS tension, round(mo, 6) AS momentum, round(CASE WHEN k >= 2 THEN mo - coalesce(lag(mo) OVER (PARTITION BY cohort ORDER BY window_id), 0) ELSE 0 END, 6) AS acceleration FROM m""")
def tension_momentum(spark, sf_dir):
    t = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).cast("int").alias("cohort"), (F.col("c_custkey") % 30).cast("int").alias("window_id")).agg((F.avg("c_acctbal") / 10000).alias("tension"))
    return rounded(vectors.momentum(t, "tension", ("cohort",)))


@query(f"WITH {STATES}, g AS (SELECT window_id, CAST(entity AS INTEGER) % 3 AS cohort_id, avg(hidden_mass) AS t, count(*) AS n FROM px GROUP BY 1, 2) SELECT window_id, CAST(cohort_id AS INTEGER) AS cohort_id, round(t, 6) AS tension, n, t > 0.5 * avg(t) OVER (PARTITION BY window_id) AS critical FROM g")
def cohort_tension(spark, sf_dir):
    return rounded(vectors.cohort_tension(_states(spark, sf_dir).withColumn("cohort_id", F.col("entity").cast("int") % 3)))


@query(f"""WITH {VECS}, d AS (SELECT entity AS window_id, list_transform(velocity, lambda x: x / greatest(displacement, 1e-10)) AS direction, displacement AS magnitude FROM mv WHERE velocity IS NOT NULL AND window_id <= 3), g AS (SELECT window_id, sum(magnitude) AS total, avg(abs(direction[1]) * magnitude) AS f, avg(direction[1] * magnitude) AS mn FROM d GROUP BY 1), u AS (SELECT window_id, i, avg(direction[i] * magnitude) AS m FROM d, generate_series(1, 7) s(i) GROUP BY 1, 2), p AS (SELECT window_id, sqrt(sum(m * m)) AS nm FROM u GROUP BY 1)
SELECT window_id, round(total, 6) AS total, round(nm / nullif(total, 0), 6) AS coherence, round(f / nullif(total, 0), 6) AS first_axis, CASE WHEN total < 1e-10 THEN 'minimal' WHEN nm / total > 0.7 THEN CASE WHEN f / total > 0.5 THEN CASE WHEN mn > 0 THEN 'expansion' ELSE 'compression' END ELSE 'shear' END ELSE 'rotation' END AS kind FROM g JOIN p USING (window_id)""")
def deformation_type(spark, sf_dir):
    m = _moved(spark, sf_dir).where("velocity IS NOT NULL AND window_id <= 3")
    d = m.select(F.col("entity").alias("window_id"), F.transform("velocity", lambda x: x / F.greatest(F.col("displacement"), F.lit(1e-10))).alias("direction"), F.col("displacement").alias("magnitude"))
    return rounded(vectors.deformation_type(d))
