"""Queries on the native operators, each with its SQL.

Floats are rounded on both sides, and NULL stands for what has no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.mathx import rnd
from geoloom.operators import aggregates, descriptors, joins, pairs, panel as P, rolling, windows
from geoloom.plans.panels import EVENTS_BY_USER, EVENTS_HOURLY, NATION_MONTHLY, ORDERS_DAILY, SHIP_DAILY, events_by_user, events_hourly, nation_monthly, orders_daily, ship_daily, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    return df.select([rnd(F.col(c), special.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LOGRET = "lr AS (SELECT indicator_id, date, ln(value) - ln(lag(value) OVER (PARTITION BY indicator_id ORDER BY date)) AS value FROM orders_daily)"
PAIRS = "p AS (SELECT a.indicator_id AS id_1, b.indicator_id AS id_2, a.date, a.value AS x, b.value AS y FROM {t} a JOIN {t} b ON a.date = b.date AND a.indicator_id < b.indicator_id)"
SAFE_CORR = "covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)"
OK = "x IS NOT NULL AND y IS NOT NULL"


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, {PAIRS.format(t='lr')}
SELECT id_1, id_2, round({SAFE_CORR}, 6) AS corr, count(*) AS n_obs FROM p WHERE {OK} GROUP BY 1, 2""")
def pair_correlation(spark, sf_dir):
    return rounded(pairs.correlation_pairs(P.log_returns(orders_daily(spark, sf_dir))))


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, {PAIRS.format(t='lr')}, c AS (SELECT id_1, id_2, {SAFE_CORR} AS corr FROM p WHERE {OK} GROUP BY 1, 2)
SELECT round(avg(abs(corr)), 6) AS mean_abs_corr, count(*) AS n_pairs,
 arg_min(id_1, (-abs(corr), id_1, id_2)) AS strong_1, arg_min(id_2, (-abs(corr), id_1, id_2)) AS strong_2, round(arg_min(corr, (-abs(corr), id_1, id_2)), 6) AS strong_corr,
 arg_min(id_1, (abs(corr), id_1, id_2)) AS weak_1, arg_min(id_2, (abs(corr), id_1, id_2)) AS weak_2, round(arg_min(corr, (abs(corr), id_1, id_2)), 6) AS weak_corr FROM c""")
def correlation_summary(spark, sf_dir):
    return rounded(pairs.correlation_summary(pairs.correlation_pairs(P.log_returns(orders_daily(spark, sf_dir)))))


GAPPY = "gappy AS (SELECT indicator_id, date, CASE WHEN extract(hour FROM date) % 5 <> 0 THEN value END AS value FROM events_hourly)"


def _gappy(spark, sf_dir):
    return events_hourly(spark, sf_dir).withColumn("value", F.when(F.hour("date") % 5 != 0, F.col("value")))


@query(f"""WITH {EVENTS_HOURLY}, {GAPPY}, f AS (SELECT indicator_id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value FROM gappy)
SELECT * FROM f WHERE value IS NOT NULL""")
def clean_series(spark, sf_dir):
    return P.clean_series(_gappy(spark, sf_dir))


@query(f"""WITH {NATION_MONTHLY}, d AS (SELECT indicator_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM nation_monthly GROUP BY 1)
SELECT d.indicator_id, d.date, last_value(n.value IGNORE NULLS) OVER (PARTITION BY d.indicator_id ORDER BY d.date) AS value FROM d LEFT JOIN nation_monthly n USING (indicator_id, date)""")
def align_to_daily(spark, sf_dir):
    return P.align_to_daily(nation_monthly(spark, sf_dir))


BY = "OVER (PARTITION BY indicator_id)"
LINE = "OVER (PARTITION BY indicator_id ORDER BY date)"


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round((value - avg(value) {BY}) / nullif(stddev_samp(value) {BY}, 0), 6) AS value FROM orders_daily")
def normalise_zscore(spark, sf_dir):
    return rounded(P.zscore(orders_daily(spark, sf_dir)))


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round((value - avg(value) {BY}) / (stddev_pop(value) {BY} + 1e-10), 6) AS value FROM orders_daily")
def normalise_zscore_pop(spark, sf_dir):
    return rounded(P.zscore(orders_daily(spark, sf_dir), 0))


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round((value - min(value) {BY}) / nullif(max(value) {BY} - min(value) {BY}, 0), 6) AS value FROM orders_daily")
def normalise_minmax(spark, sf_dir):
    return rounded(P.minmax(orders_daily(spark, sf_dir)))


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round((value - lag(value) {LINE}) / nullif(lag(value) {LINE}, 0), 6) AS value FROM orders_daily")
def returns_pct(spark, sf_dir):
    return rounded(P.pct_change(orders_daily(spark, sf_dir)))


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, date, value - lag(value) {LINE} AS d, lag(value) {LINE} AS b FROM orders_daily)
SELECT indicator_id, date, CASE WHEN b IS NOT NULL THEN round(least(greatest(d / (abs(b) + 1e-10), -10), 10), 6) END AS value FROM r""")
def returns_abs_clipped(spark, sf_dir):
    return rounded(P.abs_returns(orders_daily(spark, sf_dir), 10.0))


@query(f"WITH {ORDERS_DAILY}, {LOGRET} SELECT indicator_id, date, round(value, 6) AS value FROM lr")
def returns_log(spark, sf_dir):
    return rounded(P.log_returns(orders_daily(spark, sf_dir)))


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round(value - lag(value) {LINE}, 2) AS value FROM orders_daily")
def first_difference(spark, sf_dir):
    return rounded(P.first_difference(orders_daily(spark, sf_dir)), 2)


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, round((rank() OVER (PARTITION BY indicator_id ORDER BY value) + (count(*) OVER (PARTITION BY indicator_id, value) - 1) / 2.0) / count(*) {BY}, 6) AS value FROM orders_daily")
def normalise_rank(spark, sf_dir):
    return rounded(P.percent_rank_avg(orders_daily(spark, sf_dir)))


QEDGES = "e AS (SELECT indicator_id, list_distinct([" + ", ".join(f"quantile_cont(value, {k / 8})" for k in range(1, 8)) + "]) AS edges, min(value) AS lo FROM {t} GROUP BY 1)"


@query(f"""WITH {ORDERS_DAILY}, {QEDGES.format(t='orders_daily')} SELECT o.indicator_id, o.date, o.value, CAST(len(list_filter(e.edges, lambda x: x > e.lo AND x < o.value)) AS INTEGER) AS bin FROM orders_daily o JOIN e USING (indicator_id)""")
def discretise_quantile(spark, sf_dir):
    return P.discretise(orders_daily(spark, sf_dir), 8)


@query(f"""WITH {ORDERS_DAILY}, m AS (SELECT *, min(value) {BY} AS lo, max(value) {BY} AS hi FROM orders_daily)
SELECT indicator_id, date, value, CAST(greatest(ceil((value - lo) / nullif(hi - lo, 0) * 8) - 1, 0) AS INTEGER) AS bin FROM m""")
def discretise_width(spark, sf_dir):
    return P.discretise(orders_daily(spark, sf_dir), 8, "equal")


F21 = "OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, date, least(greatest((value - lag(value) {LINE}) / (abs(lag(value) {LINE}) + 1e-10), -10), 10) AS r0, lag(value) {LINE} AS b FROM orders_daily), s AS (SELECT indicator_id, date, CASE WHEN b IS NOT NULL THEN r0 END AS r FROM r)
SELECT indicator_id, date, round(CASE WHEN count(r) {F21} >= 10 THEN stddev_samp(r) {F21} END, 6) AS value FROM s""")
def view_volatility(spark, sf_dir):
    return rounded(P.view(orders_daily(spark, sf_dir), "VOLATILITY"))


@query(f"""WITH {ORDERS_DAILY} SELECT indicator_id, date, round(CASE WHEN count(value) {F21} >= 10 THEN (value - avg(value) {F21}) / nullif(stddev_samp(value) {F21}, 0) END, 6) AS value FROM orders_daily""")
def view_deviation(spark, sf_dir):
    return rounded(P.view(orders_daily(spark, sf_dir), "DEVIATION"))


PROFILE_SQL = """, g AS (SELECT *, date - lag(date) OVER (PARTITION BY indicator_id ORDER BY date) AS gap FROM {t}), a AS (
 SELECT indicator_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs, CAST(max(date) - min(date) AS INTEGER) AS span_days, quantile_cont(gap::DOUBLE, 0.5) AS median_interval, stddev_pop(gap) AS sd FROM g GROUP BY 1),
 b AS (SELECT *, span_days::DOUBLE / nullif(n_obs - 1, 0) AS mean_interval FROM a)
SELECT indicator_id, first_date, last_date, n_obs, span_days, round(mean_interval, 6) AS mean_interval, round(median_interval, 6) AS median_interval,
 CASE WHEN mean_interval <= 1.5 THEN 'daily' WHEN mean_interval <= 8 THEN 'weekly' WHEN mean_interval <= 35 THEN 'monthly' WHEN mean_interval <= 100 THEN 'quarterly' ELSE 'irregular' END AS frequency,
 coalesce(sd / nullif(median_interval, 0) > 0.01, false) AS is_irregular FROM b"""


@query(f"WITH {EVENTS_BY_USER}{PROFILE_SQL.format(t='events_by_user')}")
def temporal_profile_users(spark, sf_dir):
    return rounded(P.temporal_profile(events_by_user(spark, sf_dir)))


@query(f"WITH {ORDERS_DAILY}{PROFILE_SQL.format(t='orders_daily')}")
def temporal_profile_orders(spark, sf_dir):
    return rounded(P.temporal_profile(orders_daily(spark, sf_dir)))


@query(f"WITH {SHIP_DAILY} SELECT indicator_id, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(value, date) AS last_value, round(avg(value), 7) AS mean_value, round(sum(value), 2) AS sum_value FROM ship_daily GROUP BY 1, 2")
def resample_month(spark, sf_dir):
    s = ship_daily(spark, sf_dir)
    frames = [P.resample(s, "M", r).withColumnRenamed("value", f"{r}_value") for r in ("last", "mean", "sum")]
    out = frames[0].join(frames[1], ["indicator_id", "date"]).join(frames[2], ["indicator_id", "date"])
    return rounded(out, 7, sum_value=2, last_value=2)


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT *, row_number() {LINE} - 1 AS rn, count(*) {BY} AS n FROM orders_daily), w AS (SELECT indicator_id, n, unnest(generate_series(0, CAST(floor((n - 252) / 21.0) AS BIGINT))) AS window_id FROM (SELECT DISTINCT indicator_id, n FROM r WHERE n >= 252))
SELECT w.indicator_id, w.window_id, min(date) AS window_start, max(date) AS window_end, count(*) AS n_obs, round(avg(value), 7) AS mean_value FROM w JOIN r ON r.indicator_id = w.indicator_id AND r.rn BETWEEN w.window_id * 21 AND w.window_id * 21 + 251 GROUP BY 1, 2""")
def window_rowcount(spark, sf_dir):
    cut = windows.by_rows(orders_daily(spark, sf_dir), 252, 21)
    return rounded(cut.groupBy("indicator_id", "window_id", "window_start", "window_end").agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean_value")), 7)


@query(f"""WITH {ORDERS_DAILY}, s AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM orders_daily GROUP BY indicator_id)),
w AS (SELECT CAST(k AS INTEGER) AS window_id, lo + 252 + CAST(k * 21 AS INTEGER) AS window_end FROM s, generate_series(0, 1000) g(k) WHERE lo + 252 + CAST(k * 21 AS INTEGER) <= hi)
SELECT o.indicator_id, w.window_id, w.window_end - 252 AS window_start, w.window_end, count(*) AS n_obs, round(avg(value), 7) AS mean_value FROM w, s, orders_daily o WHERE o.date BETWEEN w.window_end - 252 AND w.window_end AND o.date BETWEEN s.lo AND s.hi GROUP BY 1, 2, 3, 4""")
def window_calendar(spark, sf_dir):
    cut = windows.by_days(orders_daily(spark, sf_dir), 252, 21)
    return rounded(cut.groupBy("indicator_id", "window_id", "window_start", "window_end").agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean_value")), 7)


@query(f"""WITH {NATION_MONTHLY}, s AS (SELECT max(lo) AS "start", min(hi) AS "end" FROM (SELECT min(date) AS lo, max(date) AS hi FROM nation_monthly GROUP BY indicator_id)) SELECT * FROM s WHERE "start" <= "end" """)
def common_range(spark, sf_dir):
    return windows.common_range(nation_monthly(spark, sf_dir))


REF = "1-URGENT"
F60 = "OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, date, (value - lag(value) {LINE}) / nullif(lag(value) {LINE}, 0) AS value FROM orders_daily),
b AS (SELECT a.indicator_id, a.date, a.value, f.value AS ref FROM r a JOIN r f ON a.date = f.date AND f.indicator_id = '{REF}' WHERE a.indicator_id <> '{REF}' AND a.value IS NOT NULL AND f.value IS NOT NULL),
c AS (SELECT indicator_id, date, CASE WHEN count(value) {F60.format(k='indicator_id')} >= 30 THEN covar_samp(value, ref) {F60.format(k='indicator_id')} / nullif(var_samp(ref) {F60.format(k='indicator_id')}, 0) END AS beta FROM b)
SELECT indicator_id, round(avg(beta), 6) AS beta_mean, round(stddev_pop(beta), 6) AS beta_std, round(min(beta), 6) AS beta_min, round(max(beta), 6) AS beta_max, round(arg_max(beta, date), 6) AS beta_current FROM c WHERE beta IS NOT NULL GROUP BY 1""")
def rolling_beta(spark, sf_dir):
    return rounded(rolling.beta_summary(rolling.rolling_beta(P.pct_change(orders_daily(spark, sf_dir)), REF)))


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, {PAIRS.format(t='lr')}, q AS (SELECT * FROM p WHERE {OK}),
c AS (SELECT id_1, id_2, date, CASE WHEN count(x) {F60.format(k='id_1, id_2')} = 60 THEN covar_samp(x, y) {F60.format(k='id_1, id_2')} / nullif(stddev_samp(x) {F60.format(k='id_1, id_2')} * stddev_samp(y) {F60.format(k='id_1, id_2')}, 0) END AS corr FROM q)
SELECT date, round(avg(corr), 6) AS avg_corr, round(max(corr), 6) AS max_corr, round(min(corr), 6) AS min_corr, round(stddev_samp(corr), 6) AS dispersion, count(*) AS n_pairs FROM c WHERE corr IS NOT NULL GROUP BY 1""")
def rolling_pair_corr(spark, sf_dir):
    return rounded(rolling.correlation_dispersion(rolling.rolling_pair_corr(P.log_returns(orders_daily(spark, sf_dir)))))


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, {PAIRS.format(t='lr')}, q AS (SELECT *, row_number() OVER (PARTITION BY id_1, id_2 ORDER BY date) AS rn FROM p WHERE {OK}),
c AS (SELECT a.id_1, a.id_2, CAST(g.k AS INTEGER) AS lag, covar_samp(a.x, b.y) / nullif(stddev_samp(a.x) * stddev_samp(b.y), 0) AS ccf, count(*) AS n FROM q a CROSS JOIN generate_series(-20, 20) g(k) JOIN q b ON a.id_1 = b.id_1 AND a.id_2 = b.id_2 AND b.rn = a.rn + g.k GROUP BY 1, 2, 3)
SELECT id_1, id_2, arg_min(lag, (-abs(ccf), lag)) AS peak_lag, round(arg_min(ccf, (-abs(ccf), lag)), 6) AS peak_corr, round(max(ccf) FILTER (WHERE lag = 0), 6) AS zero_lag_corr, round(avg(abs(ccf)), 6) AS mean_abs_ccf, max(n) FILTER (WHERE lag = 0) AS n_obs,
 CASE WHEN arg_min(lag, (-abs(ccf), lag)) > 0 THEN id_1 WHEN arg_min(lag, (-abs(ccf), lag)) < 0 THEN id_2 END AS leader, round(max(abs(ccf)) - avg(abs(ccf)), 6) AS decay, max(abs(ccf)) > 2 / sqrt(max(n) FILTER (WHERE lag = 0)) AS significant FROM c WHERE ccf IS NOT NULL GROUP BY 1, 2""")
def cross_correlation(spark, sf_dir):
    return rounded(pairs.best_lag(pairs.cross_correlation(P.log_returns(orders_daily(spark, sf_dir)))))


STATS_SQL = """, r AS (SELECT *, (value - lag(value) OVER w) / (abs(lag(value) OVER w) + 1e-10) AS r0, lag(value) OVER w AS b FROM {t} WINDOW w AS (PARTITION BY indicator_id ORDER BY date)),
s AS (SELECT *, CASE WHEN b IS NOT NULL THEN r0 END AS r, CASE WHEN value > 0 AND b > 0 THEN ln(value) - ln(b) END AS lr FROM r),
m AS (SELECT *, avg(r) OVER (PARTITION BY indicator_id) AS mr FROM s)
SELECT indicator_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, round(max(value) - min(value), 4) AS range, round(quantile_cont(value, 0.5), 4) AS median, count(value) AS n_obs,
 round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75, round(quantile_cont(value, 0.95), 4) AS q95,
 round(avg(r), 6) AS return_mean, round(stddev_pop(r), 6) AS return_std, round(min(r), 6) AS return_min, round(max(r), 6) AS return_max, round(avg((r - mr)**3) / nullif(power(avg((r - mr)**2), 1.5), 0), 4) AS return_skew, round(avg((r - mr)**4) / nullif(power(avg((r - mr)**2), 2), 0) - 3, 4) AS return_kurtosis,
 round(stddev_pop(CASE WHEN r < 0 THEN r END), 6) AS downside_std, round(avg(lr), 6) AS log_return_mean, round(stddev_pop(lr), 6) AS log_return_std
FROM m GROUP BY 1 HAVING count(value) >= 10"""
_STATS = dict(mean=4, std=4, min=4, max=4, range=4, median=4, q05=4, q25=4, q75=4, q95=4, return_skew=4, return_kurtosis=4)


@query(f"WITH {ORDERS_DAILY}{STATS_SQL.format(t='orders_daily')}")
def basic_stats_orders(spark, sf_dir):
    return rounded(descriptors.basic_stats(orders_daily(spark, sf_dir)), **_STATS)


@query(f"WITH {EVENTS_HOURLY}{STATS_SQL.format(t='events_hourly')}")
def basic_stats_events(spark, sf_dir):
    return rounded(descriptors.basic_stats(events_hourly(spark, sf_dir)), **_STATS)


@query(f"WITH {SHIP_DAILY}{STATS_SQL.format(t='ship_daily')}")
def basic_stats_ship(spark, sf_dir):
    return rounded(descriptors.basic_stats(ship_daily(spark, sf_dir)), **_STATS)


ACF = """d AS (SELECT indicator_id, date, value - avg(value) OVER (PARTITION BY indicator_id) AS d, row_number() OVER (PARTITION BY indicator_id ORDER BY date) AS rn FROM orders_daily),
s AS (SELECT indicator_id, count(*) AS n, sum(d * d) AS ss FROM d GROUP BY 1),
acf AS (SELECT a.indicator_id, s.n, CAST(g.k AS INTEGER) AS lag, sum(a.d * b.d) / nullif(max(s.ss), 0) AS acf FROM d a CROSS JOIN generate_series(1, 20) g(k) JOIN d b ON a.indicator_id = b.indicator_id AND b.rn = a.rn - g.k JOIN s ON s.indicator_id = a.indicator_id GROUP BY 1, 2, 3)"""


@query(f"WITH {ORDERS_DAILY}, {ACF} SELECT indicator_id, n, lag, round(acf, 6) AS acf FROM acf")
def autocorrelation(spark, sf_dir):
    return rounded(descriptors.autocorrelation(orders_daily(spark, sf_dir)))


@query(f"WITH {ORDERS_DAILY}, {ACF} SELECT indicator_id, n, round(avg(abs(acf)), 6) AS mean_abs_acf, round(n * (n + 2.0) * sum(acf * acf / (n - lag)), 4) AS ljung_box_q, min(lag) FILTER (WHERE acf <= 0) AS first_zero, CAST(sum(CASE WHEN abs(acf) > 2 / sqrt(n) THEN 1 ELSE 0 END) AS BIGINT) AS significant_lags, round(exp(-n * (n + 2.0) * sum(acf * acf / (n - lag)) / 2) * list_sum(list_transform(range(0, 10), lambda k: power(n * (n + 2.0) * sum(acf * acf / (n - lag)) / 2, k) / factorial(CAST(k AS INTEGER)))), 6) AS ljung_box_p FROM acf GROUP BY 1, 2")
def ljung_box(spark, sf_dir):
    return rounded(descriptors.ljung_box(descriptors.autocorrelation(orders_daily(spark, sf_dir))), ljung_box_q=4)


@query(f"""WITH {NATION_MONTHLY}, r AS (SELECT *, (row_number() {LINE} - 1)::DOUBLE AS rn FROM nation_monthly), c AS (SELECT *, rn - avg(rn) {BY} AS t, value - avg(value) {BY} AS v FROM r), b AS (SELECT *, sum(t * v) {BY} / nullif(sum(t * t) {BY}, 0) AS slope, t * t - avg(t * t) {BY} AS t2 FROM c), e AS (SELECT *, v - slope * t AS e FROM b)
SELECT indicator_id, count(*) AS n_obs, round(max(slope), 4) AS trend_slope, round(max(slope) * count(*) / (max(value) - min(value) + 1e-10), 6) AS trend_slope_normalized, round(1 - sum(e * e) / (sum(v * v) + 1e-10), 6) AS trend_r_squared, round(sum(t2 * v) / nullif(sum(t2 * t2), 0), 4) AS trend_quadratic_coef, round(stddev_pop(e), 3) AS detrended_std, round(max(e) - min(e), 3) AS detrended_range FROM e GROUP BY 1""")
def trend(spark, sf_dir):
    return rounded(descriptors.trend(nation_monthly(spark, sf_dir)), trend_slope=4, trend_quadratic_coef=4, detrended_std=3, detrended_range=3)


@query(f"""WITH {NATION_MONTHLY}, r AS (SELECT *, row_number() {LINE} AS rn FROM nation_monthly), s AS (SELECT a.indicator_id, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS mk_s FROM r a JOIN r b ON a.indicator_id = b.indicator_id AND b.rn > a.rn GROUP BY 1), n AS (SELECT indicator_id, count(*) AS n FROM r GROUP BY 1)
SELECT s.indicator_id, n, mk_s, round(CASE WHEN mk_s > 0 THEN (mk_s - 1) / sqrt(n * (n - 1.0) * (2 * n + 5) / 18) WHEN mk_s < 0 THEN (mk_s + 1) / sqrt(n * (n - 1.0) * (2 * n + 5) / 18) ELSE 0 END, 6) AS mk_z FROM s JOIN n USING (indicator_id)""")
def mann_kendall(spark, sf_dir):
    return rounded(descriptors.mann_kendall(nation_monthly(spark, sf_dir)))


@query(f"""WITH {SHIP_DAILY}, a AS (SELECT *, lag(value) {LINE} AS b FROM ship_daily), r AS (SELECT indicator_id, date, (value - b) / (abs(b) + 1e-10) AS r FROM a WHERE b IS NOT NULL),
v AS (SELECT *, CASE WHEN count(r) {F21} = 21 AND lead(r) {LINE} IS NOT NULL THEN stddev_pop(r) {F21} END AS rv, CASE WHEN min(r + 1) {LINE} > 0 THEN exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) {LINE}) END AS wealth, r * r AS sq, lag(r * r) {LINE} AS sqb FROM r), d AS (SELECT *, (wealth - max(wealth) {LINE}) / nullif(max(wealth) {LINE}, 0) AS dd FROM v),
g AS (SELECT indicator_id, stddev_pop(r) AS rv0, avg(rv) AS vm, stddev_pop(rv) AS vs, min(rv) AS vmin, max(rv) AS vmax, (covar_samp(sq, sqb)) / nullif(stddev_samp(CASE WHEN sqb IS NOT NULL THEN sq END) * stddev_samp(sqb), 0) AS ac, stddev_pop(CASE WHEN r < 0 THEN r END) AS dn, sqrt(avg(CASE WHEN r < 0 THEN r * r END)) AS sd, stddev_pop(CASE WHEN r > 0 THEN r END) AS up, min(dd) AS mdd, avg(r) * 252 AS ann FROM d GROUP BY 1)
SELECT indicator_id, round(rv0, 6) AS realized_volatility, round(rv0 * sqrt(252), 6) AS annualized_volatility, round(vm, 6) AS volatility_mean, round(vs, 6) AS volatility_std, round(vmin, 6) AS volatility_min, round(vmax, 6) AS volatility_max, round(vmax - vmin, 6) AS volatility_range, round(vs / nullif(vm, 0), 6) AS vol_of_vol, round(ac, 6) AS arch_autocorr, round(dn, 6) AS downside_volatility, round(sd, 6) AS sortino_denominator, round(up, 6) AS upside_volatility, round(up / (dn + 1e-10), 6) AS volatility_skew, round(mdd, 6) AS max_drawdown, round(CASE WHEN mdd < 0 THEN ann / abs(mdd) END, 4) AS calmar_ratio FROM g""")
def volatility(spark, sf_dir):
    return rounded(descriptors.volatility(ship_daily(spark, sf_dir)), calmar_ratio=4)


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, date, ln(value) - lag(ln(value)) {LINE} AS r FROM orders_daily WHERE value > 0), q AS (SELECT indicator_id, date, r, CASE WHEN count(r) OVER w = 4 THEN sum(r) OVER w END AS rq FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), g AS (SELECT indicator_id, var_pop(rq) / 4 / nullif(var_pop(r), 0) AS vr FROM q GROUP BY 1)
SELECT indicator_id, round(vr, 6) AS variance_ratio, CASE WHEN abs(vr - 1) < 0.2 THEN 'random_walk_like' WHEN vr > 1.2 THEN 'positive_autocorr' ELSE 'mean_reverting' END AS verdict FROM g""")
def variance_ratio(spark, sf_dir):
    return rounded(descriptors.variance_ratio(orders_daily(spark, sf_dir)))


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, value AS y, lag(value) {LINE} AS x FROM orders_daily), g AS (SELECT indicator_id, regr_slope(y, x) AS s FROM r WHERE x IS NOT NULL GROUP BY 1)
SELECT indicator_id, round(s, 6) AS ar1_slope, round(CASE WHEN s > 0 AND s < 1 THEN -ln(2) / ln(s) END, 6) AS half_life FROM g""")
def half_life(spark, sf_dir):
    return rounded(descriptors.half_life(orders_daily(spark, sf_dir)))
