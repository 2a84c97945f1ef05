"""Queries on selection, windows, joins, aggregates, descriptors and expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoloom.functions import mathx
from geoloom.operators import aggregates as A, baselines, cohorts, descriptors, dynamics, joins, pairs, panel as P, rolling, vectors, windows
from geoloom.plans.more_queries import NCORR, _nation_corr, erfc_tail
from geoloom.plans.native_queries import BY, GAPPY, LINE, LOGRET, _gappy, query, rounded
from geoloom.plans.panels import EVENTS_BY_USER, EVENTS_HOURLY, NATION_MONTHLY, ORDERS_DAILY, SHIP_DAILY, events_by_user, events_hourly, nation_monthly, orders_daily, ship_daily, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# ---- selection, validation, reshaping


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily WHERE indicator_id IN ('1-URGENT', '2-HIGH') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND starts_with(indicator_id, '2')")
def panel_filter(spark, sf_dir):
    return P.select_panel(orders_daily(spark, sf_dir), ["1-URGENT", "2-HIGH"], "1996-01-01", "1997-12-31", prefix="2")


@query(f"WITH {NATION_MONTHLY} SELECT DISTINCT indicator_id FROM nation_monthly")
def panel_indicators(spark, sf_dir):
    return P.indicators(nation_monthly(spark, sf_dir))


@query(f"WITH {EVENTS_BY_USER} SELECT * FROM events_by_user WHERE indicator_id IN (SELECT indicator_id FROM events_by_user GROUP BY 1 HAVING count(value) >= 7)")
def min_observations(spark, sf_dir):
    return P.min_observations(events_by_user(spark, sf_dir), 7)


@query(f"WITH {EVENTS_HOURLY}, {GAPPY} SELECT indicator_id, count(*) AS n_rows, CAST(sum((value IS NULL)::INT) AS BIGINT) AS n_null, 0::BIGINT AS n_bad, count(date) - count(DISTINCT date) AS n_duplicates, min(value) AS low, max(value) AS high, min(date) AS first_date, max(date) AS last_date, count(*) >= 10 AND count(value) > 0 AND count(date) = count(DISTINCT date) AS ok FROM gappy GROUP BY 1")
def validate_panel(spark, sf_dir):
    return P.validate_panel(_gappy(spark, sf_dir))


@query(f"""WITH {EVENTS_HOURLY}, {GAPPY}, f AS (SELECT indicator_id, value, last_value(value IGNORE NULLS) OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled FROM gappy)
SELECT indicator_id, count(*) AS rows_before, count(filled) AS rows_after, 0::BIGINT AS duplicates, count(filled) - count(value) AS nulls_filled, CASE WHEN count(filled) > count(value) THEN 'ffill_limit_5' ELSE 'none' END AS cleaning_method FROM f GROUP BY 1""")
def cleaning_report(spark, sf_dir):
    return P.cleaning_report(_gappy(spark, sf_dir))


@query(f"WITH {ORDERS_DAILY} SELECT date, " + ", ".join(f"max(value) FILTER (WHERE indicator_id = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders_daily GROUP BY 1")
def to_wide(spark, sf_dir):
    return P.to_wide(orders_daily(spark, sf_dir), PRIORITIES)


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily")
def to_long(spark, sf_dir):
    return P.to_long(P.to_wide(orders_daily(spark, sf_dir), PRIORITIES)).where("value IS NOT NULL")


@query(f"""WITH {EVENTS_HOURLY}, {GAPPY}, f AS (SELECT indicator_id, date, last_value(value IGNORE NULLS) {LINE} AS a, first_value(value IGNORE NULLS) OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gappy) SELECT indicator_id, date, coalesce(a, b) AS value FROM f""")
def fill_both_ways(spark, sf_dir):
    return P.fill_both_ways(_gappy(spark, sf_dir))


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS date, count(*) AS n, round(log10(sum(power(10, 1.5 * (value / 100) + 9.1))), 6) AS log_moment FROM events WHERE event_type = 'purchase' GROUP BY 1")
def monthly_moment(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("mag", F.col("value") / 100)
    return rounded(P.monthly_moment(e, time="ts").select("date", "n", F.log10("moment").alias("log_moment")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS (SELECT date, date - CAST(dayofweek(date) AS INTEGER) AS sunday FROM d), y AS (SELECT *, year(sunday + 3) AS y FROM s), j AS (SELECT *, make_date(y, 1, 4) AS jan4 FROM y)
SELECT date, CAST(y * 100 + (sunday - (jan4 - CAST(dayofweek(jan4) AS INTEGER))) // 7 + 1 AS INTEGER) AS epiweek, sunday FROM j""")
def epiweeks(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.withColumn("epiweek", P.date_to_epiweek(F.col("date"))).withColumn("sunday", P.epiweek_to_date(F.col("epiweek")))


@query("SELECT o_orderpriority, split_part(o_orderpriority, '-', 1) AS code, lower(split_part(o_orderpriority, '-', 2)) AS name, o_orderpriority LIKE '%LOW%' AS is_low, CASE WHEN starts_with(o_orderpriority, '1') THEN 'first' WHEN contains(o_orderpriority, 'HIGH') THEN 'high' ELSE trim(substr(o_orderpriority, 3)) END AS label, CAST(count(*) AS INTEGER) AS n, round(avg(nullif(o_totalprice, 0)), 2) AS mean FROM orders GROUP BY 1")
def string_rules(spark, sf_dir):
    p = F.col("o_orderpriority")
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("int").alias("n"), F.round(F.avg(F.nullif("o_totalprice", F.lit(0.0))), 2).alias("mean"))
    return g.select("o_orderpriority", F.split_part(p, F.lit("-"), F.lit(1)).alias("code"), F.lower(F.split_part(p, F.lit("-"), F.lit(2))).alias("name"), p.like("%LOW%").alias("is_low"), F.when(p.startswith("1"), "first").when(p.contains("HIGH"), "high").otherwise(F.trim(F.substring(p, 3, 100))).alias("label"), "n", "mean")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, sha256(props) AS digest, json_extract_string(props, '$.none') AS none FROM events")
def json_and_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.sha2(F.col("props").cast("binary"), 256).alias("digest"), F.get_json_object("props", "$.none").alias("none"))


def _chi2_tail(x: str, dof: int) -> str:
    return f"exp(-({x}) / 2) * list_sum(list_transform(range(0, {dof // 2}), lambda k: power(({x}) / 2, k) / factorial(CAST(k AS INTEGER))))"


@query(f"WITH z AS (SELECT s_suppkey, (s_acctbal - 4500) / 3000 AS z FROM supplier) SELECT s_suppkey, round({erfc_tail('z')}, 6) AS upper_tail, round({_chi2_tail('abs(z) * 10', 20)}, 6) AS chi2_tail, round(1 / (1 + exp(-z)), 6) AS logistic, round(least(greatest(z, -1), 1), 6) AS clipped, round(log2(abs(z) + 1), 6) AS log2, round(ln(abs(z) + 1), 6) AS log1p, round(atan2(z, 1.0), 6) AS angle, CAST(sign(z) AS DOUBLE) AS sign FROM z")
def special_functions(spark, sf_dir):
    z = F.col("z")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_acctbal") - 4500) / 3000).alias("z"))
    return rounded(s.select("s_suppkey", mathx.normal_sf(z).alias("upper_tail"), mathx.chi2_sf_even(F.abs(z) * 10, 20).alias("chi2_tail"), mathx.logistic(z).alias("logistic"), mathx.clip(z, -1.0, 1.0).alias("clipped"), F.log2(F.abs(z) + 1).alias("log2"), F.log1p(F.abs(z)).alias("log1p"), F.atan2(z, F.lit(1.0)).alias("angle"), F.signum(z).alias("sign")))


# ---- windows


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT *, row_number() {LINE} - 1 AS rn, count(*) {BY} AS n FROM orders_daily), w AS (SELECT indicator_id, n, unnest(generate_series(0, CAST(floor((n - 126) / 63.0) AS BIGINT))) AS window_id FROM (SELECT DISTINCT indicator_id, n FROM r WHERE n >= 126)),
c AS (SELECT w.indicator_id, w.window_id, count(value) AS n_obs, round(avg(value), 4) AS mean_value FROM w JOIN r ON r.indicator_id = w.indicator_id AND r.rn BETWEEN w.window_id * 63 AND w.window_id * 63 + 125 GROUP BY 1, 2)
SELECT * FROM c WHERE n_obs >= 0.8 * 126 AND indicator_id IN (SELECT indicator_id FROM c WHERE n_obs >= 0.8 * 126 GROUP BY 1 HAVING count(*) >= 2)""")
def window_scan(spark, sf_dir):
    cut = windows.scan_windows(orders_daily(spark, sf_dir), 0.5, 63, min_windows=2)
    return rounded(cut.groupBy("indicator_id", "window_id").agg(F.count("value").alias("n_obs"), F.avg("value").alias("mean_value")), 4)


@query(f"""WITH {NATION_MONTHLY}, p AS (SELECT indicator_id, max(date) AS hi, max(date) - CAST(ceil((max(date) - min(date))::DOUBLE / nullif(count(*) - 1, 0) * 36) AS INTEGER) AS lo FROM nation_monthly GROUP BY 1)
SELECT n.indicator_id, lo AS window_start, hi AS window_end, count(*) AS n_obs, round(sum(value), 2) AS total FROM nation_monthly n JOIN p ON n.indicator_id = p.indicator_id AND date BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def window_native_sampling(spark, sf_dir):
    n = nation_monthly(spark, sf_dir)
    cut = windows.by_native_sampling(n, P.temporal_profile(n), 30, 1.2)
    return rounded(cut.groupBy("indicator_id", "window_start", "window_end").agg(F.count("*").alias("n_obs"), F.sum("value").alias("total")), 2)


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, make_date(year(date), 1, 1) AS window_start, make_date(year(date), 12, 31) AS window_end, count(*) AS n_obs, round(avg(value), 3) AS mean_value FROM orders_daily WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3")
def window_schedule(spark, sf_dir):
    cut = windows.by_schedule(orders_daily(spark, sf_dir), windows.calendar_years(1996, 1999))
    return rounded(cut.groupBy("indicator_id", "window_start", "window_end").agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean_value")), 3)


@query(f"""WITH {EVENTS_HOURLY}, r AS (SELECT *, row_number() {LINE} - 1 AS rn, count(*) {BY} AS n FROM events_hourly), w AS (SELECT indicator_id, unnest(generate_series(0, CAST(floor((n - 63) / 5.0) AS BIGINT))) AS window_id FROM (SELECT DISTINCT indicator_id, n FROM r WHERE n >= 63))
SELECT w.indicator_id, w.window_id, count(*) AS n_obs, round(avg(value), 5) AS mean_value FROM w JOIN r ON r.indicator_id = w.indicator_id AND r.rn BETWEEN w.window_id * 5 AND w.window_id * 5 + 62 GROUP BY 1, 2""")
def window_resolution(spark, sf_dir):
    cut = windows.by_resolution(events_hourly(spark, sf_dir), "weekly")
    return rounded(cut.groupBy("indicator_id", "window_id").agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean_value")), 5)


F10 = "OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f"WITH {SHIP_DAILY} SELECT indicator_id, date, value, " + ", ".join(f"round(CASE WHEN count(value) {F10} >= 10 THEN {f}(value) {F10} END, 4) AS {n}" for n, f in (("roll_mean", "avg"), ("roll_std", "stddev_samp"), ("roll_min", "min"), ("roll_max", "max"))) + " FROM ship_daily")
def rolling_stats(spark, sf_dir):
    return rounded(rolling.rolling(ship_daily(spark, sf_dir), 10).drop("roll_var"), 4)


@query(f"WITH {SHIP_DAILY}, f AS (SELECT indicator_id, date, value, list(value) OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seen FROM ship_daily) SELECT indicator_id, date, value, round(len(list_filter(seen, lambda x: x <= value)) / len(seen), 6) AS share_below FROM f")
def percentile_of_last(spark, sf_dir):
    return rounded(rolling.percentile_of_last(ship_daily(spark, sf_dir), "value", 20, ("indicator_id",)))


@query(f"""WITH {ORDERS_DAILY}, {LOGRET} SELECT indicator_id, date, round(value, 6) AS value, round(sum(value) {LINE}, 5) AS cum_sum, round(CASE WHEN min(1 + value) {LINE} > 0 THEN exp(sum(CASE WHEN value > -1 THEN ln(1 + value) END) {LINE}) END, 5) AS cum_prod, round(max(value) {LINE}, 6) AS cum_max FROM lr WHERE date < DATE '1995-03-01'""")
def cumulative(spark, sf_dir):
    return rounded(rolling.cumulative(P.log_returns(orders_daily(spark, sf_dir)).where("date < DATE '1995-03-01'")), 6, cum_sum=5, cum_prod=5)


@query(f"""WITH {SHIP_DAILY}, r AS (SELECT indicator_id, value, (row_number() {LINE} - 1) // 5 AS block, count(*) {BY} AS n FROM ship_daily), b AS (SELECT indicator_id, block, max(value) - min(value) AS rg FROM r WHERE block * 5 < n - 5 GROUP BY 1, 2) SELECT indicator_id, round(avg(rg) / (2 * sqrt(ln(2))), 3) AS parkinson_volatility FROM b GROUP BY 1""")
def parkinson(spark, sf_dir):
    return rounded(descriptors.parkinson(ship_daily(spark, sf_dir)), 3)


@query(f"""WITH {SHIP_DAILY}, r AS (SELECT indicator_id, value, (row_number() {LINE} - 1) // 5 AS block FROM ship_daily) SELECT indicator_id, CAST(block AS BIGINT) AS block, round(max(value) - min(value), 2) AS range, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) = 5""")
def block_ranges(spark, sf_dir):
    return rounded(rolling.block_ranges(ship_daily(spark, sf_dir), 5), 2)


# ---- joins


@query("SELECT n_name, r_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def join_inner(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1, 2")
def join_left_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return joins.left_join_counts(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), s, ["n_nationkey"])


@query(f"WITH {NATION_MONTHLY}, d AS (SELECT date FROM nation_monthly GROUP BY 1 HAVING count(DISTINCT indicator_id) = (SELECT count(DISTINCT indicator_id) FROM nation_monthly)) SELECT * FROM nation_monthly WHERE date IN (SELECT date FROM d)")
def common_dates(spark, sf_dir):
    return joins.common_dates(nation_monthly(spark, sf_dir)).select("indicator_id", "date", "value")


ASIA = "SELECT n_name FROM nation WHERE n_regionkey < 2"


@query(f"WITH {NATION_MONTHLY} SELECT * FROM nation_monthly WHERE indicator_id IN ({ASIA})")
def semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("indicator_id"))
    return joins.among(nation_monthly(spark, sf_dir), ids)


@query(f"WITH {NATION_MONTHLY} SELECT * FROM nation_monthly WHERE indicator_id NOT IN ({ASIA})")
def anti_join(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("indicator_id"))
    return joins.not_among(nation_monthly(spark, sf_dir), ids)


@query(f"""WITH {ORDERS_DAILY}, l AS (SELECT date, value FROM orders_daily WHERE indicator_id = '1-URGENT' AND day(date) = 10), r AS (SELECT CAST(ts AS DATE) AS date, round(sum(value), 4) AS value FROM events GROUP BY 1), r2 AS (SELECT date - 9000 AS date, value FROM r)
SELECT l.date, l.value, arg_min(r2.date, (abs(r2.date - l.date), r2.date)) AS match_date, arg_min(r2.value, (abs(r2.date - l.date), r2.date)) AS match_value FROM l LEFT JOIN r2 ON abs(r2.date - l.date) <= 12 GROUP BY 1, 2""")
def nearest_date(spark, sf_dir):
    left = orders_daily(spark, sf_dir).where("indicator_id = '1-URGENT' AND day(date) = 10").select("date", "value")
    right = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("value")).withColumn("date", F.date_sub("date", 9000))
    return joins.nearest_within(left, right, 12)


@query(f"""WITH {ORDERS_DAILY}, {SHIP_DAILY} SELECT a.date, (a.value >= 100000)::INT + (a.value >= 300000)::INT AS state_a, (b.value >= 50000)::INT + (b.value >= 200000)::INT AS state_b FROM orders_daily a JOIN ship_daily b ON a.date = b.date WHERE a.indicator_id = '1-URGENT' AND b.indicator_id = 'R'""")
def align_states(spark, sf_dir):
    a = baselines.threshold_states(orders_daily(spark, sf_dir).where("indicator_id = '1-URGENT'"), [100000.0, 300000.0])
    b = baselines.threshold_states(ship_daily(spark, sf_dir).where("indicator_id = 'R'"), [50000.0, 200000.0])
    return joins.align_states(a, b)


# ---- aggregates, order, sets


@query("SELECT o_orderstatus, count(o_totalprice) AS n, count(DISTINCT o_totalprice) AS n_distinct, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def summary(spark, sf_dir):
    return rounded(A.summary(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice"), 2, mean=4)


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, count(DISTINCT l_quantity) AS n_distinct, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def summary_rollup(spark, sf_dir):
    return rounded(A.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", rollup=True), 6, total=2)


@query("SELECT o_orderstatus, " + ", ".join(f"max(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def conditional_pivot(spark, sf_dir):
    return A.conditional_pivot(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", PRIORITIES, F.col("o_totalprice"))


@query("SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS \"n_{s}\"" for s in "FOP") + ", count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*) AS n FROM lineitem GROUP BY 1")
def correlation_by_group(spark, sf_dir):
    return rounded(A.correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    return rounded(A.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.5, 0.95]))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_type, (-n, p_type)) AS mode, max(n) AS n FROM c GROUP BY 1")
def mode(spark, sf_dir):
    return A.mode(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf_dir):
    return A.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def top_orders_per_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return A.top_per_group(o, ["o_orderpriority"], 5, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def dedupe_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return A.dedupe(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) SELECT o_custkey, 'birth' AS change FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION ALL SELECT o_custkey, 'death' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)""")
def births_deaths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda y: o.where(F.year("o_orderdate") == y).select("o_custkey").distinct()
    return A.births_deaths(of(1996), of(1997))


@query("SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def stack_frames(spark, sf_dir):
    return A.stack(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


# ---- descriptors


@query(f"""WITH {SHIP_DAILY}, a AS (SELECT indicator_id, date, (value - lag(value) {LINE}) / (abs(lag(value) {LINE}) + 1e-10) AS r FROM ship_daily), b AS (SELECT indicator_id, date, r, lag(r) {LINE} AS rb FROM a WHERE r IS NOT NULL), c AS (SELECT indicator_id, CASE WHEN count(rb) OVER w = 20 THEN covar_samp(r, rb) OVER w / nullif(var_pop(rb) OVER w, 0) END AS beta FROM b WINDOW w AS (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT indicator_id, round(avg(beta), 6) AS self_beta_mean, round(stddev_pop(beta), 6) AS self_beta_std, count(beta) AS n_windows FROM c GROUP BY 1""")
def rolling_self_beta(spark, sf_dir):
    return rounded(descriptors.rolling_self_beta(ship_daily(spark, sf_dir)))


@query(f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, date, (value - lag(value) {LINE}) / nullif(lag(value) {LINE}, 0) * 100 AS r FROM orders_daily), e AS (SELECT indicator_id, date, r, power(r - avg(r) {BY}, 2) AS sq FROM r WHERE r IS NOT NULL), l AS (SELECT *, lag(sq) {LINE} AS sb FROM e),
g AS (SELECT indicator_id, coalesce(covar_samp(sq, sb) / nullif(stddev_samp(CASE WHEN sb IS NOT NULL THEN sq END) * stddev_samp(sb), 0), 0) AS c, var_pop(r) AS v, count(*) AS n FROM l GROUP BY 1)
SELECT indicator_id, round(c, 6) AS acf1_sq, round(v, 3) AS uncond_variance, n AS n_obs, round(least(greatest(0.5 * c, 0.05), 0.3), 6) AS alpha, round(0.9 - least(greatest(0.5 * c, 0.05), 0.3), 6) AS beta, round(v * 0.1, 3) AS omega FROM g""")
def garch(spark, sf_dir):
    return rounded(descriptors.garch_heuristic(orders_daily(spark, sf_dir)), 6, uncond_variance=3, omega=3)


def _rs_sql(sizes: str, sd: str) -> str:
    return f"""WITH {ORDERS_DAILY}, r AS (SELECT indicator_id, value AS x, row_number() {LINE} - 1 AS rn, count(*) {BY} AS n FROM orders_daily), z AS ({sizes}),
s AS (SELECT r.indicator_id, size, rn // size AS seg, rn, x - avg(x) OVER (PARTITION BY r.indicator_id, size, rn // size) AS d, x FROM r JOIN z ON r.indicator_id = z.indicator_id WHERE (rn // size + 1) * size <= r.n),
y AS (SELECT *, sum(d) OVER (PARTITION BY indicator_id, size, seg ORDER BY rn) AS y FROM s), g AS (SELECT indicator_id, size, seg, max(y) - min(y) AS rg, {sd}(x) AS sd FROM y GROUP BY 1, 2, 3), q AS (SELECT indicator_id, size, avg(rg / sd) AS rs FROM g WHERE sd > 1e-10 GROUP BY 1, 2), h AS (SELECT indicator_id, count(*) AS n_sizes, regr_slope(ln(rs), ln(size)) AS hurst FROM q WHERE rs > 0 GROUP BY 1)"""


@query(_rs_sql("SELECT indicator_id, unnest(list_filter([20, 30, 45, 67, 100, 150, 225, 337, 505, 757, 1135], lambda s: s <= n // 4)) AS size FROM (SELECT DISTINCT indicator_id, n FROM r)", "stddev_samp")
       + " SELECT indicator_id, n_sizes, round(hurst, 6) AS hurst, CASE WHEN hurst > 0.55 THEN 'trending' WHEN hurst < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS label FROM h WHERE n_sizes >= 3")
def hurst_levels(spark, sf_dir):
    return rounded(descriptors.hurst_rs(orders_daily(spark, sf_dir), "geometric"))


@query(_rs_sql("SELECT indicator_id, unnest(list_filter([n // 2, n // 4, n // 8, n // 16], lambda s: s >= 10)) AS size FROM (SELECT DISTINCT indicator_id, n FROM r)", "stddev_pop")
       + " SELECT indicator_id, n_sizes, round(hurst, 6) AS hurst, CASE WHEN hurst > 0.5 THEN 'persistent' WHEN hurst < 0.5 THEN 'anti_persistent' ELSE 'random_walk' END AS label FROM h")
def hurst_quarters(spark, sf_dir):
    return rounded(descriptors.hurst_rs(orders_daily(spark, sf_dir), "quarters"))


@query(f"""WITH {SHIP_DAILY}, a AS (SELECT indicator_id, date, value, row_number() {LINE} AS rn, count(*) {BY} AS n, value - lag(value) {LINE} AS dx, avg(value) {BY} AS mean, median(value) {BY} AS med FROM ship_daily),
b AS (SELECT *, sum(value - mean) {LINE} AS acc, dx * dx AS sq, sign(value - med) AS side, sign(value - mean) AS ms, quantile_cont(abs(dx), 0.9) {BY} AS cut, arg_min(rn, (-value, rn)) {BY} AS peak FROM a),
c AS (SELECT *, lag(sq) {LINE} AS sb, coalesce(abs(dx) >= cut, false) AS ext, (side <> lag(side) {LINE})::INT AS ch, (ms * lag(ms) {LINE} < 0)::INT AS cr FROM b),
g AS (SELECT indicator_id, max(n) AS n, abs(regr_slope(value, rn) FILTER (WHERE rn <= peak)) AS rise, abs(regr_slope(value, rn) FILTER (WHERE rn >= peak)) AS fall, var_pop(acc) FILTER (WHERE rn <= n / 2) AS va, var_pop(acc) FILTER (WHERE rn > n / 2) AS vb, kurtosis_pop(dx) AS k4,
 covar_samp(sq, sb) / nullif(stddev_samp(CASE WHEN sb IS NOT NULL THEN sq END) * stddev_samp(sb), 0) AS arch, sum(ext::INT) AS k, min(rn) FILTER (WHERE ext) AS e1, max(rn) FILTER (WHERE ext) AS e2, coalesce(sum(ch), 0) AS ch, sum((side > 0)::INT)::DOUBLE AS p, sum((side <= 0)::INT)::DOUBLE AS q, avg(cr) AS crossing_rate, avg(dx) AS drift, stddev_pop(dx) AS dsd, arg_max(value, rn) - arg_min(value, rn) AS net FROM c GROUP BY 1),
h AS (SELECT *, 2 * p * q / (p + q) + 1 AS ex, 2 * p * q * (2 * p * q - p - q) / ((p + q) * (p + q) * (p + q - 1)) AS va2, abs(net / sqrt(n) / (dsd + 1e-10)) AS nd FROM g)
SELECT indicator_id, round(coalesce(least(greatest(abs(rise - fall) / nullif(rise + fall, 0), 0), 1), 0), 6) AS asymmetry, round(coalesce(least(greatest(least(va, vb) / nullif(greatest(va, vb), 0), 0), 1), 0), 6) AS bounded_accumulation, round(least(greatest(k4 / 6, 0), 1), 6) AS fat_tails, round(k4, 6) AS excess_kurtosis,
 round(coalesce(least(greatest(arch * 2, 0), 1), 0), 6) AS volatility_clustering, round(arch, 6) AS arch_effect, round(coalesce(least(greatest((n - 1) / k / nullif((e2 - e1) / nullif(k - 1, 0), 0) - 1, 0), 1), 0), 6) AS tail_dependence, round(crossing_rate, 6) AS crossing_rate, round(2 * {erfc_tail('nd')}, 6) AS drift_score, round(CASE WHEN va2 > 0 THEN (ch + 1 - ex) / sqrt(va2) END, 6) AS runs_z, round(drift * sqrt(n) / nullif(dsd, 0), 6) AS drift_t FROM h""")
def signature_diagnostics(spark, sf_dir):
    return rounded(descriptors.signature_diagnostics(ship_daily(spark, sf_dir)))


# ---- pairs


@query(f"WITH {NCORR} SELECT id_1, id_2, round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.2")
def strong_pairs(spark, sf_dir):
    return rounded(pairs.strong_pairs(_nation_corr(spark, sf_dir), 0.2, None).select("id_1", "id_2", "corr"))


@query(f"WITH {NCORR}, k AS (SELECT *, row_number() OVER (ORDER BY abs(corr) DESC, id_1, id_2) AS k FROM c WHERE abs(corr) >= 0.1) SELECT id_1, id_2, round(corr, 6) AS corr FROM k WHERE k <= 10")
def strongest_pairs(spark, sf_dir):
    return rounded(pairs.strong_pairs(_nation_corr(spark, sf_dir), 0.1, 10).select("id_1", "id_2", "corr"))


@query(f"""WITH {ORDERS_DAILY}, {LOGRET}, p AS (SELECT a.indicator_id AS id_1, b.indicator_id AS id_2, a.date, a.value AS x, b.value AS y FROM lr a JOIN lr b ON a.date = b.date AND a.indicator_id < b.indicator_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY id_1, id_2 ORDER BY date) AS rn FROM p),
c AS (SELECT a.id_1, a.id_2, CAST(g.k AS INTEGER) AS lag, covar_samp(a.x, b.y) / nullif(stddev_samp(a.x) * stddev_samp(b.y), 0) AS ccf FROM q a CROSS JOIN generate_series(-5, 5) g(k) JOIN q b ON a.id_1 = b.id_1 AND a.id_2 = b.id_2 AND b.rn = a.rn + g.k GROUP BY 1, 2, 3), m AS (SELECT id_1, id_2, arg_min(lag, (-abs(ccf), lag)) AS peak FROM c WHERE ccf IS NOT NULL GROUP BY 1, 2)
SELECT CAST(sum((peak > 0)::INT) AS BIGINT) AS n_leading, CAST(sum((peak < 0)::INT) AS BIGINT) AS n_lagging, CAST(sum((peak = 0)::INT) AS BIGINT) AS n_synchronous FROM m""")
def lead_counts(spark, sf_dir):
    return pairs.lead_counts(pairs.best_lag(pairs.cross_correlation(P.log_returns(orders_daily(spark, sf_dir)), 5)))


# ---- states and cohorts


QST = "ed AS (SELECT indicator_id, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.67) AS b FROM ship_daily GROUP BY 1), st AS (SELECT s.indicator_id, s.date, s.value, (a <= value)::INT + (b <= value)::INT AS state FROM ship_daily s JOIN ed USING (indicator_id))"


@query(f"""WITH {SHIP_DAILY}, {QST}, c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) {LINE} THEN 1 ELSE 0 END AS ch FROM st), k AS (SELECT *, sum(ch) {LINE} AS run FROM c), r AS (SELECT indicator_id, run, state, count(*) AS length FROM k GROUP BY 1, 2, 3)
SELECT indicator_id, state, CAST(sum(length) AS BIGINT) AS n, round(avg(length), 6) AS mean_dwell_time, count(*) AS n_episodes, round(sum(length) / sum(sum(length)) OVER (PARTITION BY indicator_id), 6) AS proportion FROM r GROUP BY 1, 2""")
def dwell_times(spark, sf_dir):
    return rounded(vectors.dwell(baselines.quantile_states(ship_daily(spark, sf_dir))))


@query(f"""WITH {ORDERS_DAILY}, s AS (SELECT date, (value >= 100000)::INT + (value >= 300000)::INT AS state FROM orders_daily WHERE indicator_id = '1-URGENT'), o AS (SELECT *, CASE WHEN coalesce(date - lag(date) OVER (PARTITION BY state ORDER BY date) > 3, true) THEN 1 ELSE 0 END AS o FROM s), p AS (SELECT *, sum(o) OVER (PARTITION BY state ORDER BY date) AS period FROM o)
SELECT state, CAST(period AS BIGINT) AS period, min(date) AS first, max(date) AS last, count(*) AS n_points FROM p GROUP BY 1, 2""")
def state_ranges(spark, sf_dir):
    s = baselines.threshold_states(orders_daily(spark, sf_dir).where("indicator_id = '1-URGENT'"), [100000.0, 300000.0])
    return vectors.state_ranges(s.select("date", "state"), 3)


@query(f"""WITH {ORDERS_DAILY}, {SHIP_DAILY}, s AS (SELECT date FROM orders_daily WHERE indicator_id = '1-URGENT' AND value >= 300000), n AS (SELECT DISTINCT d.date FROM ship_daily d JOIN s ON abs(d.date - s.date) <= 2) SELECT indicator_id, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std FROM ship_daily WHERE date IN (SELECT date FROM n) GROUP BY 1""")
def bounded_by_state(spark, sf_dir):
    s = baselines.threshold_states(orders_daily(spark, sf_dir).where("indicator_id = '1-URGENT'"), [300000.0])
    near = cohorts.near_state(ship_daily(spark, sf_dir), s.select("date", "state"), 1, 2)
    return rounded(near.groupBy("indicator_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), 3)


@query(f"""WITH {EVENTS_BY_USER}, s AS (SELECT min(date) AS lo, max(date) AS hi FROM events_by_user), r AS (SELECT indicator_id, date, date - lag(date) {LINE} AS gap FROM events_by_user), g AS (SELECT indicator_id, count(*) AS n, min(date) AS f, max(date) AS l, quantile_cont(gap::DOUBLE, 0.5) AS mg, max(gap) AS xg, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM r GROUP BY 1),
w AS (SELECT indicator_id, dayofweek(date) AS wd, count(*) AS c FROM events_by_user GROUP BY 1, 2), e AS (SELECT indicator_id, c / sum(c) {BY} AS p FROM w), h AS (SELECT indicator_id, -sum(p * log2(p)) AS we FROM e GROUP BY 1)
SELECT g.indicator_id, round(greatest(1 - n / greatest((l - f) / greatest(mg, 1.0) + 1, 1.0), 0), 6) AS missing_rate, round(coalesce(mg, 0), 6) AS median_gap, coalesce(xg::DOUBLE, 0) AS max_gap, round(coalesce(cv, 0), 6) AS gap_cv, round(we, 6) AS weekday_entropy, round((f - lo)::DOUBLE / (hi - lo + 1), 6) AS start_share, round((hi - l)::DOUBLE / (hi - lo + 1), 6) AS end_share FROM g JOIN h USING (indicator_id), s""")
def observation_features(spark, sf_dir):
    return rounded(cohorts.observation_features(events_by_user(spark, sf_dir)))


PROJ = "pr AS (SELECT CAST(label AS VARCHAR) AS indicator_id, CAST(vec_id % 3 AS INTEGER) AS state, " + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS {c}" for i, c in enumerate(cohorts.BEHAVIOUR)) + " FROM embeddings GROUP BY 1, 2)"


def _projected(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").cast("string").alias("indicator_id"), (F.col("vec_id") % 3).cast("int").alias("state")).agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(c) for i, c in enumerate(cohorts.BEHAVIOUR)])


@query(f"WITH {PROJ} SELECT state, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in cohorts.BEHAVIOUR) + " FROM pr GROUP BY 1")
def state_centroids(spark, sf_dir):
    return rounded(cohorts.state_centroids(_projected(spark, sf_dir)))


@query(f"WITH {PROJ} SELECT a.indicator_id, a.state AS state_1, b.state AS state_2, round(sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cohorts.BEHAVIOUR) + "), 6) AS distance FROM pr a JOIN pr b ON a.indicator_id = b.indicator_id AND a.state < b.state")
def state_movements(spark, sf_dir):
    return rounded(cohorts.movements(_projected(spark, sf_dir)))


PROFILE = "pf AS (SELECT CAST(label AS VARCHAR) AS indicator_id, CAST(label % 2 AS INTEGER) AS cohort_id, i AS dimension, avg(embedding[i]::DOUBLE) AS value FROM embeddings, generate_series(1, 8) g(i) GROUP BY 1, 2, 3)"


def _profiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("indicator_id"), (F.col("label") % 2).cast("int").alias("cohort_id"), F.posexplode(F.slice("embedding", 1, 8)).alias("at", "v"))
    return e.groupBy("indicator_id", "cohort_id", (F.col("at") + 1).cast("long").alias("dimension")).agg(F.avg(F.col("v").cast("double")).alias("value"))


@query(f"""WITH {PROFILE}, d AS (SELECT a.indicator_id AS source, b.indicator_id AS target, sum((a.value - b.value) * (a.value - b.value)) AS d2 FROM pf a JOIN pf b ON a.dimension = b.dimension AND a.indicator_id <> b.indicator_id GROUP BY 1, 2), m AS (SELECT CAST(label AS VARCHAR) AS indicator_id, count(*)::DOUBLE AS mass FROM embeddings GROUP BY 1)
SELECT source, target, round(d2, 6) AS d2, mass, round(mass / nullif(d2, 0), 3) AS influence FROM d JOIN m ON m.indicator_id = d.source""")
def macro_influence(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("indicator_id")).agg(F.count("*").cast("double").alias("mass"))
    return rounded(cohorts.macro_influence(_profiles(spark, sf_dir), m).select("source", "target", "d2", "mass", "influence"), 6, influence=3)


@query(f"WITH {PROFILE}, z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM pf WINDOW w AS (PARTITION BY cohort_id, dimension)) SELECT indicator_id, cohort_id, dimension, round(value, 6) AS value, round(z, 5) AS z FROM z WHERE abs(z) > 1.2")
def micro_outliers(spark, sf_dir):
    return rounded(cohorts.micro_outliers(_profiles(spark, sf_dir), 1.2), 6, z=5)


WCORR = f"""{ORDERS_DAILY}, {LOGRET}, yr AS (SELECT indicator_id, date, value, CAST(year(date) AS INTEGER) AS window_id FROM lr), yp AS (SELECT a.window_id, a.indicator_id AS id_1, b.indicator_id AS id_2, a.value AS x, b.value AS y FROM yr a JOIN yr b ON a.date = b.date AND a.indicator_id < b.indicator_id), wc AS (SELECT window_id, id_1, id_2, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS corr FROM yp WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)"""


def yearly_corr(spark, sf_dir):
    r = P.log_returns(orders_daily(spark, sf_dir)).withColumn("window_id", F.year("date"))
    return pairs.correlation_pairs(r, ("window_id",)), r


@query(f"""WITH {WCORR}, b AS (SELECT window_id, id_1 AS indicator_id, abs(corr) AS r FROM wc UNION ALL SELECT window_id, id_2, abs(corr) FROM wc), g AS (SELECT window_id, indicator_id, avg(r) AS c, 1 - max(r) AS u FROM b GROUP BY 1, 2), v AS (SELECT window_id, indicator_id, stddev_pop(value) AS vol FROM yr GROUP BY 1, 2), j AS (SELECT g.*, vol, percent_rank() OVER (PARTITION BY g.window_id ORDER BY vol) AS vr FROM g JOIN v USING (window_id, indicator_id))
SELECT window_id, indicator_id, round(c, 6) AS centrality, round(u, 6) AS uniqueness, round(vol, 6) AS volatility, round(vr, 6) AS volatility_rank, round(0.4 * c + 0.3 * vr + 0.3 * u, 6) AS importance FROM j""")
def system_positions(spark, sf_dir):
    c, r = yearly_corr(spark, sf_dir)
    v = r.groupBy("window_id", "indicator_id").agg(F.stddev_pop("value").alias("volatility"))
    return rounded(cohorts.system_positions(c, v))


@query(f"""WITH {WCORR}, s AS (SELECT window_id, avg(corr) AS m, stddev_pop(corr) AS d, CAST(sum((corr > 0)::INT) AS BIGINT) AS k FROM wc GROUP BY 1), l AS (SELECT window_id, m, d, k, CASE WHEN d > 0.4 THEN 'crisis' WHEN m > 0.6 AND k / 10 < 0.3 THEN 'aligned' WHEN m < 0.3 OR k / 10 > 0.5 THEN 'divergent' ELSE 'transitioning' END AS regime FROM s), c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY window_id) THEN 1 ELSE 0 END AS ch FROM l), r AS (SELECT *, sum(ch) OVER (ORDER BY window_id) AS run FROM c)
SELECT regime, min(window_id) AS first, max(window_id) AS last, count(*) AS n_windows FROM r GROUP BY run, regime""")
def regime_periods(spark, sf_dir):
    c, _ = yearly_corr(spark, sf_dir)
    s = c.groupBy("window_id").agg(F.avg("corr").alias("m"), F.stddev_pop("corr").alias("d"), F.sum((F.col("corr") > 0).cast("int")).alias("k"))
    return vectors.regime_periods(s.withColumn("regime", vectors.regime_label(F.col("m"), F.col("d"), F.col("k"), F.lit(10))))


ASSIGNED = "asg AS (SELECT CAST(vec_id % 5 AS INTEGER) AS window_id, CAST(vec_id // 5 AS VARCHAR) AS indicator_id, CAST(label % 4 AS INTEGER) AS cluster FROM embeddings)"


def _assigned(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("window_id"), F.floor(F.col("vec_id") / 5).cast("string").alias("indicator_id"), (F.col("label") % 4).cast("int").alias("cluster"))


@query(f"""WITH {ASSIGNED}, r AS (SELECT *, lag(cluster) OVER (PARTITION BY indicator_id ORDER BY window_id) AS b FROM asg), g AS (SELECT window_id, count(DISTINCT b) AS k_before, count(DISTINCT cluster) AS k_after, count(DISTINCT (b, cluster)) AS links, count(*) AS n FROM r WHERE b IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN links = k_before AND links = k_after THEN 'stable' WHEN links = k_after THEN 'split' WHEN links = k_before THEN 'merge' ELSE 'reconfigure' END AS kind FROM g""")
def cluster_evolution(spark, sf_dir):
    from geoloom.operators import grouped

    return grouped.evolution(_assigned(spark, sf_dir))


# ---- dynamics


POINTS = "pt AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS v FROM embeddings), dt AS (SELECT vec_id, sqrt(4 * v[1] * v[1] + 2 * 0.5 * v[1] * v[2] + 3 * v[2] * v[2]) AS distance FROM pt)"


@query(f"WITH {POINTS} SELECT vec_id, round(distance, 6) AS distance, distance <= 0.3 AS inside, round(cume_dist() OVER (ORDER BY distance), 9) AS percentile FROM dt")
def home_distance(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("vector"))
    return rounded(dynamics.distance_to(p, [0.0, 0.0], [[4.0, 0.5], [0.5, 3.0]], 0.3).drop("vector"), 6, percentile=9)


TALL = "tl AS (SELECT CAST(label AS VARCHAR) AS indicator_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS window_id, embedding FROM embeddings), tv AS (SELECT indicator_id, window_id, CAST(i AS INTEGER) AS dimension, embedding[i]::DOUBLE AS value FROM tl, generate_series(1, 7) g(i))"


def _tall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("indicator_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("window_id"), "embedding")
    return e.select("indicator_id", "window_id", F.posexplode(F.slice("embedding", 1, 7)).alias("at", "v")).select("indicator_id", "window_id", (F.col("at") + 1).alias("dimension"), F.col("v").cast("double").alias("value"))


MOTION = f"{TALL}, dd AS (SELECT indicator_id, window_id, value - lag(value) OVER (PARTITION BY indicator_id, dimension ORDER BY window_id) AS d FROM tv), mm AS (SELECT indicator_id, window_id, sqrt(sum(d * d)) AS distance, count(*) AS n_dims FROM dd WHERE d IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {MOTION}, z AS (SELECT *, (distance - avg(distance) {BY}) / nullif(stddev_pop(distance) {BY}, 0) AS z, exp(-avg(distance) {BY}) AS rs FROM mm) SELECT indicator_id, window_id, round(distance, 6) AS distance, n_dims, round(z, 5) AS z, coalesce(abs(z) > 2, false) AS anomalous, round(rs, 6) AS resistance FROM z")
def vector_motion(spark, sf_dir):
    return rounded(dynamics.vector_motion(_tall(spark, sf_dir)), 6, z=5)


@query(f"""WITH {MOTION}, l AS (SELECT *, lag(distance) OVER (PARTITION BY indicator_id ORDER BY window_id) AS b, avg(distance) OVER (PARTITION BY indicator_id ORDER BY window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mo, avg(distance) {BY} AS m, stddev_pop(distance) {BY} AS sd FROM mm), a AS (SELECT *, distance - b AS ac FROM l)
SELECT indicator_id, window_id, round(distance, 6) AS speed, round(ac, 6) AS acceleration, round(mo, 6) AS momentum, CASE WHEN distance > m + 2 * sd THEN 'jumping' WHEN abs(ac) <= 0.1 * m THEN CASE WHEN distance < 0.5 * m THEN 'steady' ELSE 'drifting' END WHEN ac > 0 THEN 'accelerating' WHEN ac < 0 THEN 'decelerating' ELSE 'steady' END AS behaviour FROM a""")
def behaviour_snapshots(spark, sf_dir):
    return rounded(dynamics.snapshots(dynamics.vector_motion(_tall(spark, sf_dir))).select("indicator_id", "window_id", "speed", "acceleration", "momentum", "behaviour"))


@query(f"""WITH {TALL}, d AS (SELECT indicator_id, window_id % 3 AS cohort_id, window_id, dimension, value - avg(value) OVER (PARTITION BY window_id % 3, window_id, dimension) AS d FROM tv), f AS (SELECT cohort_id, window_id, indicator_id, sqrt(sum(d * d)) AS distance FROM d GROUP BY 1, 2, 3), z AS (SELECT *, (distance - avg(distance) OVER w) / nullif(stddev_pop(distance) OVER w, 0) AS z FROM f WINDOW w AS (PARTITION BY cohort_id, window_id))
SELECT CAST(cohort_id AS INTEGER) AS cohort_id, window_id, indicator_id, round(distance, 6) AS distance, round(z, 5) AS z, coalesce(z > 1.5, false) AS hidden_mass FROM z""")
def hidden_mass(spark, sf_dir):
    d = _tall(spark, sf_dir).withColumn("cohort_id", F.col("window_id") % 3)
    return rounded(dynamics.hidden_mass(d, z_limit=1.5), 6, z=5)


FRAMES = "fr AS (SELECT CAST(c_nationkey AS VARCHAR) AS indicator_id, CAST(c_custkey % 4 AS INTEGER) AS window_id, avg(c_acctbal + 1000) / 10000 AS tension, stddev_pop(c_acctbal) / 10000 AS velocity FROM customer GROUP BY 1, 2)"


@query(f"""WITH {FRAMES}, r AS (SELECT *, tension / sum(tension) OVER w AS p, row_number() OVER (PARTITION BY window_id ORDER BY tension, indicator_id) AS rk, count(*) OVER w AS n FROM fr WINDOW w AS (PARTITION BY window_id)), g AS (SELECT window_id, avg(tension) AS mt, -sum(CASE WHEN p > 0 THEN p * ln(p) END) AS e, max(n) AS n, sum(rk * tension) AS rt, sum(tension) AS t, avg(abs(velocity)) AS sp FROM r GROUP BY 1), h AS (SELECT *, 2 * rt / nullif(n * t, 0) - (n + 1) / n AS gini FROM g)
SELECT window_id, round(mt, 6) AS mean_tension, round(e, 6) AS entropy, round(e / nullif(ln(n), 0), 6) AS relative_entropy, round(gini, 6) AS gini, round(1 / (1 + exp(-(4 * (mt + sp + gini - 1)))), 6) AS rupture_risk FROM h""")
def interpretation(spark, sf_dir):
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("indicator_id"), (F.col("c_custkey") % 4).cast("int").alias("window_id")).agg((F.avg(F.col("c_acctbal") + 1000) / 10000).alias("tension"), (F.stddev_pop("c_acctbal") / 10000).alias("velocity"))
    return rounded(dynamics.interpretation(f))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)\\b(ring|bolt)\\b')")
def semantic_guard(spark, sf_dir):
    return dynamics.semantic_guard(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], ("ring", "bolt"))
