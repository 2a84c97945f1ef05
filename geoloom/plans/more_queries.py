"""Further queries with SQL: memory, entropy, information, dependence, cohorts, dynamics, rules, evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoloom.operators import aggregates, baselines, descriptors, dynamics, graph, joins, pairs, panel as P, policy, rolling
from geoloom.functions.mathx import ERFC
from geoloom.plans.native_queries import BY, F21, LINE, LOGRET, OK, PAIRS, QEDGES, SAFE_CORR, query, rounded
from geoloom.plans.panels import EVENTS_HOURLY, NATION_MONTHLY, ORDERS_DAILY, SHIP_DAILY, events_hourly, nation_monthly, orders_daily, ship_daily, table


@query(f"""WITH {ORDERS_DAILY}, x AS (SELECT indicator_id, date, value - lag(value) {LINE} AS x FROM orders_daily), r AS (SELECT indicator_id, x, row_number() {LINE} - 1 AS rn, count(*) {BY} AS n FROM x WHERE x IS NOT NULL),
z AS (SELECT indicator_id, n, unnest(generate_series(8, least(n // 2, 100), greatest(least(n // 2, 100) // 20, 1))) AS size FROM (SELECT DISTINCT indicator_id, n FROM r)),
s AS (SELECT r.indicator_id, size, rn // size AS seg, rn, x - avg(x) OVER (PARTITION BY r.indicator_id, size, rn // size) AS d, x FROM r JOIN z ON r.indicator_id = z.indicator_id WHERE (rn // size + 1) * size <= r.n),
y AS (SELECT *, sum(d) OVER (PARTITION BY indicator_id, size, seg ORDER BY rn) AS y FROM s), g AS (SELECT indicator_id, size, seg, max(y) - min(y) AS rg, stddev_samp(x) AS sd FROM y GROUP BY 1, 2, 3), q AS (SELECT indicator_id, size, avg(rg / sd) AS rs FROM g WHERE sd > 1e-10 GROUP BY 1, 2),
h AS (SELECT indicator_id, count(*) AS n_sizes, least(greatest(regr_slope(ln(rs), ln(size)), 0), 1) AS hurst FROM q WHERE rs > 0 GROUP BY 1)
SELECT indicator_id, n_sizes, round(hurst, 6) AS hurst, CASE WHEN hurst < 0.4 THEN 'mean_reverting' WHEN hurst > 0.6 THEN 'trending' ELSE 'random_walk' END AS label FROM h""")
def hurst_rs(spark, sf_dir):
    return rounded(descriptors.hurst_rs(orders_daily(spark, sf_dir), "diff"))


@query(f"""WITH {ORDERS_DAILY}, d AS (SELECT indicator_id, date, value - avg(value) {BY} AS d, count(*) {BY} AS n FROM orders_daily), y AS (SELECT indicator_id, n, sum(d) {LINE} AS y, row_number() {LINE} - 1 AS rn FROM d),
s AS (SELECT indicator_id, sc.s AS scale, rn // sc.s AS seg, rn % sc.s AS t, y FROM y CROSS JOIN (VALUES (4), (8), (16), (32), (64)) sc(s) WHERE sc.s * 4 <= n AND (rn // sc.s + 1) * sc.s <= n),
g AS (SELECT indicator_id, scale, seg, greatest(var_pop(y) - covar_pop(t, y) * covar_pop(t, y) / nullif(var_pop(t), 0), 0) AS rss FROM s GROUP BY 1, 2, 3), f AS (SELECT indicator_id, scale, sqrt(avg(rss)) AS fl FROM g GROUP BY 1, 2)
SELECT indicator_id, round(regr_slope(ln(fl), ln(scale)), 6) AS hurst_dfa FROM f WHERE fl > 0 GROUP BY 1""")
def hurst_dfa(spark, sf_dir):
    return rounded(descriptors.dfa(orders_daily(spark, sf_dir)))


@query(f"""WITH {EVENTS_HOURLY}, {QEDGES.format(t='events_hourly')}, b AS (SELECT o.indicator_id, len(list_filter(e.edges, lambda x: x > e.lo AND x < o.value)) AS bin FROM events_hourly o JOIN e USING (indicator_id)), c AS (SELECT indicator_id, bin, count(*) AS c FROM b GROUP BY 1, 2), p AS (SELECT indicator_id, c / sum(c) {BY} AS p FROM c)
SELECT indicator_id, round(-sum(p * log2(p)), 6) AS shannon_entropy, count(*) AS n_bins FROM p GROUP BY 1""")
def shannon_entropy(spark, sf_dir):
    return rounded(descriptors.shannon_entropy(P.discretise(events_hourly(spark, sf_dir), 8)))


@query(f"""WITH {EVENTS_HOURLY}, l AS (SELECT indicator_id, value AS a, lead(value, 1) {LINE} AS b, lead(value, 2) {LINE} AS c FROM events_hourly), k AS (SELECT indicator_id, (a > b)::INT * 4 + (a > c)::INT * 2 + (b > c)::INT AS k FROM l WHERE c IS NOT NULL), n AS (SELECT indicator_id, k, count(*) AS n FROM k GROUP BY 1, 2), p AS (SELECT indicator_id, n / sum(n) {BY} AS p FROM n)
SELECT indicator_id, round(-sum(p * log2(p)) / log2(6), 6) AS permutation_entropy FROM p GROUP BY 1""")
def permutation_entropy(spark, sf_dir):
    return rounded(descriptors.permutation_entropy(events_hourly(spark, sf_dir)))


@query(f"""WITH {NATION_MONTHLY}, r AS (SELECT indicator_id, row_number() {LINE} AS rn, 0.2 * stddev_pop(value) {BY} AS tol, value AS v0, lead(value, 1) {LINE} AS v1, lead(value, 2) {LINE} AS v2 FROM nation_monthly), f AS (SELECT * FROM r WHERE v2 IS NOT NULL),
g AS (SELECT a.indicator_id, count(*) AS b, CAST(sum(CASE WHEN abs(a.v2 - b.v2) <= a.tol THEN 1 ELSE 0 END) AS BIGINT) AS a FROM f a JOIN f b ON a.indicator_id = b.indicator_id AND b.rn > a.rn AND abs(a.v0 - b.v0) <= a.tol AND abs(a.v1 - b.v1) <= a.tol GROUP BY 1)
SELECT indicator_id, a, b, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END, 6) AS sample_entropy FROM g""")
def sample_entropy(spark, sf_dir):
    return rounded(descriptors.sample_entropy(nation_monthly(spark, sf_dir)))


@query(f"""WITH {NATION_MONTHLY}, r AS (SELECT indicator_id, value, row_number() {LINE} AS rn, 0.1 * (max(value) {BY} - min(value) {BY}) AS tol FROM nation_monthly)
SELECT a.indicator_id, round(avg(CASE WHEN abs(a.value - b.value) <= a.tol THEN 1.0 ELSE 0.0 END), 6) AS recurrence_rate FROM r a JOIN r b ON a.indicator_id = b.indicator_id AND b.rn > a.rn GROUP BY 1""")
def recurrence_rate(spark, sf_dir):
    return rounded(descriptors.recurrence_rate(nation_monthly(spark, sf_dir)))


BINNED = f"{QEDGES.format(t='events_hourly')}, b AS (SELECT o.indicator_id, o.date, o.value, len(list_filter(e.edges, lambda x: x > e.lo AND x < o.value)) AS bin FROM events_hourly o JOIN e USING (indicator_id))"


@query(f"""WITH {EVENTS_HOURLY}, {BINNED}, p AS (SELECT a.indicator_id AS id_1, b.indicator_id AS id_2, a.bin AS b1, b.bin AS b2, a.value AS x, b.value AS y FROM b a JOIN b ON a.date = b.date AND a.indicator_id < b.indicator_id),
c AS (SELECT id_1, id_2, b1, b2, count(*)::DOUBLE AS c FROM p GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY id_1, id_2) AS n, sum(c) OVER (PARTITION BY id_1, id_2, b1) AS c1, sum(c) OVER (PARTITION BY id_1, id_2, b2) AS c2 FROM c),
h AS (SELECT id_1, id_2, sum(c / n * ln(c * n / (c1 * c2))) AS mi, -sum(c / n * ln(c1 / n)) AS h1, -sum(c / n * ln(c2 / n)) AS h2, max(n)::BIGINT AS n_obs FROM m GROUP BY 1, 2), r AS (SELECT id_1, id_2, {SAFE_CORR} AS corr FROM p GROUP BY 1, 2)
SELECT id_1, id_2, round(mi, 6) AS mi, round(h1, 6) AS h1, round(h2, 6) AS h2, n_obs, round(corr, 6) AS corr, round(2 * mi / nullif(h1 + h2, 0), 6) AS nmi, round(CASE WHEN abs(corr) < 0.3 THEN mi END, 6) AS nonlinear_excess FROM h JOIN r USING (id_1, id_2)""")
def mutual_information(spark, sf_dir):
    return rounded(pairs.mutual_information(events_hourly(spark, sf_dir)))


@query(f"""WITH {EVENTS_HOURLY}, {BINNED}, j AS (SELECT a.indicator_id AS source, b.indicator_id AS target, a.bin AS s, b.bin AS t, lead(b.bin) OVER (PARTITION BY a.indicator_id, b.indicator_id ORDER BY a.date) AS nx FROM b a JOIN b ON a.date = b.date AND a.indicator_id <> b.indicator_id),
c AS (SELECT source, target, nx, t, s, count(*)::DOUBLE AS c FROM j WHERE nx IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY source, target) AS n, sum(c) OVER (PARTITION BY source, target, t) AS ct, sum(c) OVER (PARTITION BY source, target, nx, t) AS cnt, sum(c) OVER (PARTITION BY source, target, t, s) AS cts FROM c)
SELECT source, target, round(sum(c / n * log2(c * ct / (cnt * cts))), 6) AS te, max(n)::BIGINT AS n_obs FROM m GROUP BY 1, 2""")
def transfer_entropy(spark, sf_dir):
    return rounded(pairs.transfer_entropy(events_hourly(spark, sf_dir)))


def erfc_tail(x: str) -> str:
    """Upper tail of the normal distribution in SQL, by the fit that the expression uses."""
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({poly} * (1 / (1 + 0.5 * abs({x}) / sqrt(2))) + ({c!r}))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1 / (1 + 0.5 * abs({x}) / sqrt(2))) * exp(-({x}) * ({x}) / 2 + {poly}) ELSE 1 - 0.5 * (1 / (1 + 0.5 * abs({x}) / sqrt(2))) * exp(-({x}) * ({x}) / 2 + {poly}) END)"


def _tail(sign: str, q: float) -> str:
    hit = (lambda c: f"{c} <= {q}") if sign == "lower" else (lambda c: f"{c} >= {1 - q}")
    return f"coalesce(sum(CASE WHEN {hit('u')} AND {hit('v')} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN {hit('u')} THEN 1.0 ELSE 0 END), 0), 0)"


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, {PAIRS.format(t='lr')}, q AS (SELECT * FROM p WHERE {OK}), k AS (SELECT id_1, id_2, count(*) OVER (PARTITION BY id_1, id_2) AS n, rank() OVER (PARTITION BY id_1, id_2 ORDER BY x) + (count(*) OVER (PARTITION BY id_1, id_2, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY id_1, id_2 ORDER BY y) + (count(*) OVER (PARTITION BY id_1, id_2, y) - 1) / 2.0 AS y FROM q),
w AS (SELECT *, x / (n + 1) AS u, y / (n + 1) AS v FROM k), g AS (SELECT id_1, id_2, count(*) AS n_obs, {SAFE_CORR} AS spearman, ({' + '.join(_tail('lower', q) for q in (0.05, 0.1, 0.15))}) / 3 AS lo, ({' + '.join(_tail('upper', q) for q in (0.05, 0.1, 0.15))}) / 3 AS hi, avg(CASE WHEN u > 0.9 AND v > 0.9 THEN 1.0 ELSE 0 END) AS je FROM w GROUP BY 1, 2)
SELECT id_1, id_2, n_obs, round(spearman, 6) AS spearman, round(lo, 6) AS lower_tail, round(hi, 6) AS upper_tail, round(je, 6) AS joint_exceedance, round(hi - lo, 6) AS tail_asymmetry, round(2 * {erfc_tail('sz')}, 6) AS spearman_p FROM (SELECT *, abs(spearman) * sqrt(n_obs - 1.0) AS sz FROM g)""")
def rank_dependence(spark, sf_dir):
    return rounded(pairs.rank_dependence(P.log_returns(orders_daily(spark, sf_dir))))


@query(f"""WITH {NATION_MONTHLY}, {PAIRS.format(t='nation_monthly')}, sz AS (SELECT id_1, id_2, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), g AS (SELECT a.id_1, a.id_2, CAST(sum(sign(b.x - a.x) * sign(b.y - a.y)) AS BIGINT) AS s, sum(abs(sign(b.x - a.x))) AS nx, sum(abs(sign(b.y - a.y))) AS ny FROM p a JOIN p b ON a.id_1 = b.id_1 AND a.id_2 = b.id_2 AND b.date > a.date GROUP BY 1, 2), t AS (SELECT id_1, id_2, s, s / nullif(sqrt(nx * ny::DOUBLE), 0) AS tau, n FROM g JOIN sz USING (id_1, id_2)), tz AS (SELECT *, abs(3 * tau * sqrt(n * (n - 1)) / sqrt(2 * (2 * n + 5))) AS z FROM t)
SELECT id_1, id_2, s AS kendall_s, round(tau, 6) AS tau, round(2 * {erfc_tail('z')}, 6) AS tau_p, round(CASE WHEN tau < 1 THEN 1 / (1 - tau) END, 6) AS gumbel_theta, round(CASE WHEN tau < 1 THEN 2 * tau / (1 - tau) END, 6) AS clayton_theta FROM tz""")
def kendall(spark, sf_dir):
    return rounded(pairs.kendall(nation_monthly(spark, sf_dir)))


@query(f"""WITH {ORDERS_DAILY}, z AS (SELECT indicator_id, date, (value - avg(value) {BY}) / nullif(stddev_samp(value) {BY}, 0) AS value FROM orders_daily), {PAIRS.format(t='z')}
SELECT id_1, id_2, round(sqrt(sum((x - y) * (x - y))), 5) AS euclidean, round(1 - sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 6) AS cosine, round(1 - abs({SAFE_CORR}), 6) AS correlation FROM p WHERE {OK} GROUP BY 1, 2""")
def distances(spark, sf_dir):
    return rounded(pairs.distances(P.zscore(orders_daily(spark, sf_dir))), euclidean=5)


@query(f"""WITH {ORDERS_DAILY}, {PAIRS.format(t='orders_daily')}, b AS (SELECT *, regr_slope(y, x) OVER w AS beta, avg(y) OVER w - regr_slope(y, x) OVER w * avg(x) OVER w AS alpha FROM p WINDOW w AS (PARTITION BY id_1, id_2)), s AS (SELECT *, y - alpha - beta * x AS s FROM b), l AS (SELECT *, lag(s) OVER (PARTITION BY id_1, id_2 ORDER BY date) AS sb FROM s),
g AS (SELECT id_1, id_2, max(beta) AS beta, max(alpha) AS alpha, stddev_pop(s) AS sd, arg_max(s, date) AS last, regr_slope(s - sb, sb) AS lam FROM l GROUP BY 1, 2)
SELECT id_1, id_2, round(beta, 6) AS hedge_ratio, round(alpha, 2) AS alpha, round(sd, 2) AS spread_std, round(last / nullif(sd, 0), 6) AS spread_z, round(CASE WHEN lam < 0 THEN -ln(2) / lam END, 6) AS half_life FROM g""")
def spread(spark, sf_dir):
    return rounded(pairs.spread(orders_daily(spark, sf_dir)), alpha=2, spread_std=2)


NCORR = f"""{NATION_MONTHLY}, nlr AS (SELECT indicator_id, date, ln(value) - ln(lag(value) OVER (PARTITION BY indicator_id ORDER BY date)) AS value FROM nation_monthly), {PAIRS.format(t='nlr')}, c AS (SELECT id_1, id_2, {SAFE_CORR} AS corr FROM p WHERE {OK} GROUP BY 1, 2)"""


def _nation_corr(spark, sf_dir):
    return pairs.correlation_pairs(P.log_returns(nation_monthly(spark, sf_dir)))


@query(f"""WITH {NCORR}, b AS (SELECT id_1 AS indicator_id, abs(corr) AS r FROM c UNION ALL SELECT id_2, abs(corr) FROM c)
SELECT indicator_id, CAST(sum(CASE WHEN r >= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS degree, round(avg(r), 6) AS mean_abs_corr, round(max(r), 6) AS max_abs_corr, count(*) AS n_others, round(1 - avg(r), 6) AS isolation, round(sum(CASE WHEN r >= 0.2 THEN 1.0 ELSE 0 END) / count(*), 6) AS degree_share FROM b GROUP BY 1""")
def network(spark, sf_dir):
    return rounded(pairs.network(_nation_corr(spark, sf_dir), 0.2))


@query(f"WITH {NCORR} SELECT round(avg(CASE WHEN abs(corr) >= 0.2 THEN 1.0 ELSE 0 END), 6) AS density, round(avg(abs(corr)), 6) AS mean_abs_corr, count(*) AS n_pairs FROM c")
def network_density(spark, sf_dir):
    return rounded(pairs.density(_nation_corr(spark, sf_dir), 0.2))


@query(f"""WITH RECURSIVE {NCORR}, e AS (SELECT id_1 AS a, id_2 AS b FROM c WHERE abs(corr) >= 0.25 UNION SELECT id_2, id_1 FROM c WHERE abs(corr) >= 0.25), n AS (SELECT DISTINCT indicator_id AS node FROM nation_monthly),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), k AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT node, component, size FROM k JOIN s USING (component)""")
def cohorts(spark, sf_dir):
    nodes = nation_monthly(spark, sf_dir).select(F.col("indicator_id").alias("node")).distinct()
    return graph.discover_cohorts(_nation_corr(spark, sf_dir), nodes, 0.25, 2)


DIST = "s AS (SELECT indicator_id AS entity, date, abs(value - avg(value) OVER (PARTITION BY indicator_id)) / nullif(stddev_pop(value) OVER (PARTITION BY indicator_id), 0) AS distance FROM events_hourly)"
ELINE = "OVER (PARTITION BY entity ORDER BY date)"


def _distance(spark, sf_dir):
    w = Window.partitionBy("indicator_id")
    return events_hourly(spark, sf_dir).select(F.col("indicator_id").alias("entity"), "date", (F.abs(F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)).alias("distance"))


@query(f"""WITH {EVENTS_HOURLY}, {DIST}, v AS (SELECT *, distance - lag(distance) {ELINE} AS velocity FROM s), a AS (SELECT *, velocity - lag(velocity) {ELINE} AS acceleration FROM v)
SELECT entity, date, round(distance, 6) AS distance, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, CASE WHEN distance <= 1 THEN 'inside' WHEN velocity < -0.05 THEN 'reverting' WHEN velocity > 0.05 THEN 'escalating' ELSE 'stalling' END AS state FROM a""")
def trajectory_state(spark, sf_dir):
    return rounded(dynamics.trajectory_state(_distance(spark, sf_dir), 1.0))


@query(f"""WITH {EVENTS_HOURLY}, {DIST}, v AS (SELECT *, distance - lag(distance) {ELINE} AS v, min(distance) OVER w20 AS l20, max(distance) OVER w20 AS h20, count(*) OVER w20 AS n20, min(distance) OVER w60 AS l60, max(distance) OVER w60 AS h60, count(*) OVER w60 AS n60 FROM s WINDOW w20 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), w60 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
n AS (SELECT entity, arg_max(distance, date) AS d, arg_max(v, date) AS nv FROM v GROUP BY 1), m AS (SELECT v.* FROM v JOIN n USING (entity) WHERE abs(distance - d) <= 0.2 * d AND sign(v) = sign(nv))
SELECT entity, round(avg(CASE WHEN n20 = 20 THEN (l20 <= 1)::INT END), 6) AS p_reentry_20, round(avg(CASE WHEN n20 = 20 THEN (h20 > distance * 1.2)::INT END), 6) AS p_escalate_20, count(*) FILTER (WHERE n20 = 20) AS n_similar_20,
 round(avg(CASE WHEN n60 = 60 THEN (l60 <= 1)::INT END), 6) AS p_reentry_60, round(avg(CASE WHEN n60 = 60 THEN (h60 > distance * 1.2)::INT END), 6) AS p_escalate_60, count(*) FILTER (WHERE n60 = 60) AS n_similar_60 FROM m GROUP BY 1""")
def hazards(spark, sf_dir):
    return rounded(dynamics.hazards(_distance(spark, sf_dir), 1.0))


@query(f"""WITH {EVENTS_HOURLY}, {DIST}, v AS (SELECT *, lead(distance) {ELINE} - distance AS v FROM s), g AS (SELECT entity, avg(-v / (distance - 1)) AS pull, count(*) AS n FROM v WHERE distance > 1 AND v < 0 GROUP BY 1)
SELECT entity, round(pull, 4) AS pull, n, round(CASE WHEN pull > 0 THEN ln(2) / pull END, 4) AS half_life FROM g""")
def pull_strength(spark, sf_dir):
    return rounded(dynamics.pull_strength(_distance(spark, sf_dir), 1.0), 4)


@query(f"""WITH {EVENTS_HOURLY}, {DIST}, v AS (SELECT entity, lead(distance) {ELINE} - distance AS d, distance - 1 AS x FROM s), g AS (SELECT entity, regr_slope(d, x) AS beta, regr_intercept(d, x) AS alpha, regr_r2(d, x) AS r2, count(*) AS n FROM v WHERE d IS NOT NULL GROUP BY 1)
SELECT entity, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r_squared, n, round(CASE WHEN beta < 0 AND beta > -1 THEN -ln(2) / ln(1 + beta) END, 6) AS half_life FROM g""")
def mean_reversion(spark, sf_dir):
    return rounded(dynamics.mean_reversion(_distance(spark, sf_dir), 1.0))


EXC = f"o AS (SELECT *, distance > 1 AS outside, max(date) OVER (PARTITION BY entity) AS fin FROM s), c AS (SELECT *, CASE WHEN outside IS DISTINCT FROM lag(outside) {ELINE} THEN 1 ELSE 0 END AS ch FROM o), k AS (SELECT *, sum(ch) {ELINE} AS run FROM c), x AS (SELECT entity, run, min(date) AS first, max(date) AS last, count(*) AS days, max(distance) AS peak, avg(distance) AS mean_distance, max(date) = max(fin) AS open FROM k WHERE outside GROUP BY 1, 2)"


@query(f"WITH {EVENTS_HOURLY}, {DIST}, {EXC} SELECT entity, first, last, days, round(peak, 6) AS peak, round(mean_distance, 6) AS mean_distance, open FROM x")
def excursions(spark, sf_dir):
    return rounded(dynamics.excursions(_distance(spark, sf_dir), 1.0))


@query(f"""WITH {EVENTS_HOURLY}, {DIST}, {EXC}, t AS (SELECT *, distance - lag(distance) {ELINE} AS st, outside <> lag(outside) {ELINE} AS cr FROM o), a AS (SELECT entity, count(*) AS n, avg(outside::INT) AS rate, coalesce(sum(cr::INT), 0) AS crossings, avg(abs(st)) AS churn FROM t GROUP BY 1), b AS (SELECT entity, count(*) AS episodes, max(days) AS longest, avg(days) AS mean_days, max(peak) AS peak FROM x GROUP BY 1)
SELECT a.entity, n, round(rate, 6) AS excursion_rate, CAST(crossings AS BIGINT) AS crossings, round(churn, 6) AS churn, coalesce(episodes, 0) AS episodes, longest, round(mean_days, 6) AS mean_days, round(peak, 6) AS peak FROM a LEFT JOIN b ON a.entity = b.entity""")
def excursion_summary(spark, sf_dir):
    return rounded(dynamics.excursion_summary(_distance(spark, sf_dir), 1.0))


@query(f"""WITH {EVENTS_HOURLY}, h AS (SELECT date, sum(value) AS v FROM events_hourly GROUP BY 1), f AS (SELECT date, v > avg(v) OVER () + stddev_pop(v) OVER () AS flag FROM h), o AS (SELECT date FROM (SELECT *, lag(flag) OVER (ORDER BY date) AS b FROM f) WHERE flag AND NOT coalesce(b, false)),
m AS (SELECT indicator_id, date, lead(value, 20) {LINE} - value AS ch FROM events_hourly), g AS (SELECT indicator_id, count(*) AS n_episodes, avg(ch) AS mc, stddev_pop(ch) AS sc FROM m SEMI JOIN o USING (date) WHERE ch IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT *, mc / nullif(sc, 0) AS ef FROM g)
SELECT indicator_id, n_episodes, round(mc, 5) AS mean_change, round(sc, 5) AS std_change, round(ef, 6) AS effect, CAST(row_number() OVER (ORDER BY abs(ef) DESC, indicator_id) AS INTEGER) AS place FROM e""")
def conditional_attribution(spark, sf_dir):
    p = events_hourly(spark, sf_dir)
    total = p.groupBy("date").agg(F.sum("value").alias("v"))
    bar = F.broadcast(total.agg((F.avg("v") + F.stddev_pop("v")).alias("bar")))
    flag = total.crossJoin(bar).select("date", (F.col("v") > F.col("bar")).alias("flag"))
    return rounded(dynamics.conditional_attribution(flag, p), mean_change=5, std_change=5)


QST = "ed AS (SELECT indicator_id, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.67) AS b FROM ship_daily GROUP BY 1), st AS (SELECT s.indicator_id, s.date, s.value, (a <= value)::INT + (b <= value)::INT AS state FROM ship_daily s JOIN ed USING (indicator_id))"


@query(f"""WITH {SHIP_DAILY}, {QST}, t AS (SELECT indicator_id, state, lead(state) {LINE} AS next_state FROM st), n AS (SELECT indicator_id, state, next_state, count(*) AS n FROM t WHERE next_state IS NOT NULL GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY indicator_id, state), 6) AS p FROM n""")
def transition_matrix(spark, sf_dir):
    return rounded(baselines.transition_matrix(baselines.quantile_states(ship_daily(spark, sf_dir))))


@query(f"""WITH {ORDERS_DAILY} SELECT indicator_id, date, value, (value >= 100000)::INT + (value >= 300000)::INT + (value >= 600000)::INT AS state FROM orders_daily""")
def threshold_states(spark, sf_dir):
    return baselines.threshold_states(orders_daily(spark, sf_dir), [100000.0, 300000.0, 600000.0])


@query(f"""WITH {ORDERS_DAILY}, m AS (SELECT indicator_id, date, avg(value) OVER f AS fast, avg(value) OVER s AS slow, count(*) OVER s AS n FROM orders_daily WINDOW f AS (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), s AS (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)), a AS (SELECT *, (fast > slow)::INT - lag((fast > slow)::INT) {LINE} AS turn FROM m WHERE n = 200)
SELECT indicator_id, date, round(fast, 6) AS fast, round(slow, 6) AS slow, CASE WHEN turn > 0 THEN 'golden' ELSE 'death' END AS "cross" FROM a WHERE turn <> 0""")
def average_crosses(spark, sf_dir):
    return rounded(baselines.average_crosses(orders_daily(spark, sf_dir)), 6)


METRICS = """m AS (SELECT c_mktsegment AS indicator_id, (avg(c_acctbal) + 1000) / 11000 AS geometric_influence, stddev_pop(c_acctbal) / 5000 AS marginal_contribution, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS stability, (max(c_acctbal) - 9000) / 1000 AS noise_pressure, NULL::DOUBLE AS confidence_effect FROM customer GROUP BY 1),
w AS (SELECT indicator_id, 0.30 * least(greatest(geometric_influence, 0), 1) + 0.20 * least(greatest(marginal_contribution, 0), 1) + 0.25 * least(greatest(stability, 0), 1) + 0.15 * least(greatest(noise_pressure, 0), 1) + 0.10 * 0.5 AS ics FROM m), h AS (SELECT indicator_id, ics, 1 - ics AS failure_ratio FROM w)"""


def _metrics(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.count()
    return c.groupBy(F.col("c_mktsegment").alias("indicator_id")).agg(
        ((F.avg("c_acctbal") + 1000) / 11000).alias("geometric_influence"), (F.stddev_pop("c_acctbal") / 5000).alias("marginal_contribution"), (F.count("*") / F.lit(float(n))).alias("stability"), ((F.max("c_acctbal") - 9000) / 1000).alias("noise_pressure"), F.lit(None).cast("double").alias("confidence_effect")
    )


@query(f"WITH {METRICS} SELECT indicator_id, round(ics, 6) AS ics, round(failure_ratio, 6) AS failure_ratio, CASE WHEN failure_ratio > 0.6 THEN 'exclude_candidate' WHEN failure_ratio > 0.4 THEN 'review' ELSE 'keep' END AS hint FROM h")
def contribution(spark, sf_dir):
    return rounded(policy.contribution(_metrics(spark, sf_dir)).select("indicator_id", "ics", "failure_ratio", "hint"))


@query(f"WITH {METRICS} SELECT indicator_id, round(failure_ratio, 6) AS failure_ratio, failure_ratio > 0.43 AS would_exclude, failure_ratio <= 0.43 OR row_number() OVER (ORDER BY (failure_ratio > 0.43)::INT, failure_ratio, indicator_id) <= 2 AS active FROM h")
def exclusion(spark, sf_dir):
    out = policy.apply_exclusion(policy.contribution(_metrics(spark, sf_dir)), threshold=0.43, min_indicators=2)
    return rounded(out.select("indicator_id", "failure_ratio", "would_exclude", "active"))


@query(f"""WITH {EVENTS_HOURLY}, r AS (SELECT indicator_id, value AS v, 1 AS r, 0 AS c FROM events_hourly UNION ALL SELECT indicator_id, least(greatest(value, 100), 300), 0, 1 FROM events_hourly), p AS (SELECT indicator_id, v, sum(r) AS r, sum(c) AS c FROM r GROUP BY 1, 2), k AS (SELECT indicator_id, sum(r) {BY} AS nr, sum(c) {BY} AS nc, abs(sum(r) OVER w / sum(r) {BY} - sum(c) OVER w / sum(c) {BY}) AS d FROM p WINDOW w AS (PARTITION BY indicator_id ORDER BY v)), g AS (SELECT indicator_id, max(d) AS ks, sqrt(-0.5 * ln(0.005)) * sqrt((max(nr) + max(nc)) / (max(nr) * max(nc))) AS cr FROM k GROUP BY 1)
SELECT indicator_id, round(ks, 6) AS ks, round(cr, 6) AS critical, ks > cr AS shifted FROM g""")
def ks_shift(spark, sf_dir):
    both = events_hourly(spark, sf_dir).select("indicator_id", F.col("value").alias("raw"), F.least(F.greatest("value", F.lit(100.0)), F.lit(300.0)).alias("cleaned"))
    return rounded(policy.ks_shift(both))


@query(f"""WITH {EVENTS_HOURLY} SELECT indicator_id, round(var_samp(least(greatest(value, 100), 300)) / nullif(var_samp(value), 0), 6) AS variance_ratio, coalesce(var_samp(least(greatest(value, 100), 300)) / nullif(var_samp(value), 0) < 0.5, false) AS collapsed FROM events_hourly GROUP BY 1""")
def variance_collapse(spark, sf_dir):
    both = events_hourly(spark, sf_dir).select("indicator_id", F.col("value").alias("raw"), F.least(F.greatest("value", F.lit(100.0)), F.lit(300.0)).alias("cleaned"))
    return rounded(policy.variance_collapse(both))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(log10(sum(power(10, 1.5 * (value / 100) + 4.8))), 6) AS energy, round(max(value), 6) AS max_mag, round(avg(value), 6) AS mean_mag FROM events WHERE event_type = 'purchase' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT date, coalesce(n, 0) AS n, energy, max_mag, mean_mag FROM s LEFT JOIN d USING (date)""")
def daily_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("mag", F.col("value") / 100).withColumn("depth", F.lit(0.0))
    out = P.daily_events(e, time="ts")
    return rounded(out.select("date", "n", "energy", (F.col("max_mag") * 100).alias("max_mag"), (F.col("mean_mag") * 100).alias("mean_mag")))


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), d AS (SELECT x.label, vec_id, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (label, i) GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(d), 6) AS mean_distance, round(1 / (1 + avg(d)), 6) AS cohesion FROM d GROUP BY 1""")
def cohesion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = e.select("label", "vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    centre = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d = x.join(centre, ["label", "i"]).groupBy("label", "vec_id").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("d"))
    return rounded(d.groupBy("label").agg(F.count("*").alias("n"), F.avg("d").alias("mean_distance"), (1 / (1 + F.avg("d"))).alias("cohesion")))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2)
SELECT a.label AS label_1, b.label AS label_2, round(sum(a.m * b.m) / nullif(sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)), 0), 5) AS coupling FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def domain_coupling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    a, b = c.select(F.col("label").alias("label_1"), "i", F.col("m").alias("x")), c.select(F.col("label").alias("label_2"), "i", F.col("m").alias("y"))
    g = a.join(b, "i").where("label_1 < label_2").groupBy("label_1", "label_2").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("coupling"))
    return rounded(g, 5)


STEPS = "l AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), m AS (SELECT label AS indicator_id, vec_id, CASE WHEN b IS NOT NULL THEN sqrt(list_sum(list_transform(range(1, len(b) + 1), lambda i: (embedding[i]::DOUBLE - b[i]::DOUBLE) * (embedding[i]::DOUBLE - b[i]::DOUBLE)))) END AS step FROM l)"


@query(f"WITH {STEPS} SELECT indicator_id, vec_id, round(step, 6) AS step FROM m")
def vector_steps(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("indicator_id"), "vec_id", F.col("embedding").alias("vector"))
    return rounded(dynamics.array_motion(e, ["indicator_id"], "vec_id").select("indicator_id", "vec_id", "step"))


@query(f"""WITH {STEPS}, j AS (SELECT *, step > avg(step) {BY} + 1.5 * stddev_pop(step) {BY} AS jump FROM m WHERE step IS NOT NULL), g AS (SELECT indicator_id, count(*) AS n_steps, avg(step) AS ms, stddev_pop(step) AS ss, max(step) AS xs, CAST(sum(jump::INT) AS BIGINT) AS transitions FROM j GROUP BY 1)
SELECT indicator_id, n_steps, round(ms, 6) AS mean_step, round(ss, 6) AS std_step, round(xs, 6) AS max_step, transitions, round(transitions / n_steps, 6) AS transition_rate, round(1 / (1 + coalesce(ss / nullif(ms, 0), 0)), 6) AS smoothness, round(0.4 * (1 - transitions / n_steps) + 0.3 / (1 + coalesce(ss / nullif(ms, 0), 0)) + 0.3 * ms / nullif(xs, 0), 6) AS persistence FROM g""")
def persistence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("indicator_id"), "vec_id", F.col("embedding").alias("vector"))
    return rounded(dynamics.persistence(dynamics.array_motion(e, ["indicator_id"], "vec_id")))


EVS = "ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error'), sg AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase' AND value > 200)"


@query(f"WITH {EVS} SELECT ev.event_id, ev.date, min(sg.date) AS first_signal, CAST(ev.date - min(sg.date) AS INTEGER) AS lead_days FROM ev LEFT JOIN sg ON sg.date BETWEEN ev.date - 10 AND ev.date GROUP BY 1, 2")
def lead_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ev = e.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("event_id"), F.to_date("ts").alias("date"))
    sg = e.where("event_type = 'purchase' AND value > 200").select(F.to_date("ts").alias("date"))
    return joins.first_before(ev, sg, 10)


@query(f"WITH {EVS}, f AS (SELECT sg.date, NOT EXISTS (SELECT 1 FROM ev WHERE ev.date BETWEEN sg.date - 5 AND sg.date + 5) AS fp FROM sg) SELECT count(*) AS n_signals, CAST(sum(fp::INT) AS BIGINT) AS n_false, round(avg(fp::INT), 6) AS false_rate FROM f")
def false_positives(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ev = e.where("event_type = 'error'").select(F.to_date("ts").alias("date"))
    sg = e.where("event_type = 'purchase' AND value > 200").select(F.to_date("ts").alias("date"))
    return rounded(baselines.false_positives(sg, ev))


@query(f"""WITH {NATION_MONTHLY}, w AS (SELECT indicator_id, CAST(extract(year FROM date) AS INTEGER) AS window_id, avg(value) AS level, stddev_pop(value) AS vol FROM nation_monthly GROUP BY 1, 2), s AS (SELECT 'level' AS lens, window_id, indicator_id, round(level, 2) AS score FROM w UNION ALL SELECT 'vol', window_id, indicator_id, round(vol, 2) FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY lens, window_id ORDER BY score DESC, indicator_id) AS rk FROM s), m AS (SELECT window_id, indicator_id, avg(rk) AS mean_rank, count(*) AS n_lenses FROM r GROUP BY 1, 2)
SELECT window_id, indicator_id, round(mean_rank, 6) AS mean_rank, n_lenses, CAST(row_number() OVER (PARTITION BY window_id ORDER BY mean_rank, indicator_id) AS INTEGER) AS consensus_rank FROM m""")
def lens_consensus(spark, sf_dir):
    w = nation_monthly(spark, sf_dir).groupBy("indicator_id", F.year("date").alias("window_id")).agg(F.avg("value").alias("level"), F.stddev_pop("value").alias("vol"))
    s = w.select(F.lit("level").alias("lens"), "window_id", "indicator_id", F.round("level", 2).alias("score")).unionByName(w.select(F.lit("vol").alias("lens"), "window_id", "indicator_id", F.round("vol", 2).alias("score")))
    return rounded(aggregates.consensus(aggregates.rank_in_windows(s)))
