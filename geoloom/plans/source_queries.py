"""Queries that write the tables in the formats of the sources and sinks and read them back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import panel as P
from geoloom.plans.native_queries import LINE, query, rounded
from geoloom.plans.panels import EVENTS_HOURLY, NATION_MONTHLY, ORDERS_DAILY, events_hourly, nation_monthly, orders_daily, table
from geoloom.sources import readers as R, writers as W
from geoloom.sources.scratch import folder

TWO = ["1-URGENT", "5-LOW"]


def _json(rows, path: str, key: str | None = None, order: str = "date") -> str:
    """All rows as one JSON document, {key: [...]} or [...]: what a service answers."""
    whole = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("v"))
    text = F.to_json("v") if key is None else F.to_json(F.struct(F.col("v").alias(key)))
    whole.select(text.alias("value")).coalesce(1).write.text(path)
    return path


@query(f"""WITH {ORDERS_DAILY}, o AS (SELECT * FROM orders_daily WHERE indicator_id IN ('1-URGENT', '5-LOW')), g AS (SELECT i.indicator_id, d.date, o.value FROM (SELECT DISTINCT indicator_id FROM o) i CROSS JOIN (SELECT DISTINCT date FROM o) d LEFT JOIN o ON o.indicator_id = i.indicator_id AND o.date = d.date),
f AS (SELECT indicator_id, date, last_value(value IGNORE NULLS) {LINE} AS a, first_value(value IGNORE NULLS) OVER (PARTITION BY indicator_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g) SELECT indicator_id, date, coalesce(a, b) AS value FROM f""")
def source_csv_wide(spark, sf_dir):
    path = folder(spark, "wide") + ".csv"
    W.export_csv(P.to_wide(orders_daily(spark, sf_dir).where(F.col("indicator_id").isin(TWO)), TWO), path)
    return R.csv_wide(spark, path).select("indicator_id", "date", "value")


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily")
def source_csv_long(spark, sf_dir):
    path = folder(spark, "long")
    W.export_csv(orders_daily(spark, sf_dir).select(F.col("date").alias("Date"), F.col("indicator_id").alias("Ticker"), F.col("value").alias("Close")), path)
    return R.csv_any(spark, path)


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily WHERE indicator_id IN ('1-URGENT', '5-LOW')")
def source_csv_detected_wide(spark, sf_dir):
    path = folder(spark, "any")
    W.export_csv(P.to_wide(orders_daily(spark, sf_dir), TWO), path)
    return R.csv_any(spark, path).select("indicator_id", "date", "value")


_VIEW = "g AS (SELECT indicator_id, count(*) AS n_obs, min(date) AS first_date, max(date) AS last_date FROM nation_monthly GROUP BY 1), d AS (SELECT *, n_obs / (last_date - first_date + 1.0) AS density FROM g)"


@query(f"WITH {NATION_MONTHLY}, {_VIEW} SELECT indicator_id, n_obs, first_date, last_date, CASE WHEN density > 0.5 THEN 'daily' WHEN density > 0.1 THEN 'weekly' WHEN density > 0.025 THEN 'monthly' WHEN density > 0.008 THEN 'quarterly' ELSE 'annual' END AS frequency FROM d")
def source_registry_view(spark, sf_dir):
    return R.registry_views(nation_monthly(spark, sf_dir))[0]


@query(f"WITH {NATION_MONTHLY} SELECT *, CAST(row_number() {LINE} AS INTEGER) AS obs FROM nation_monthly")
def source_series_view(spark, sf_dir):
    return R.registry_views(nation_monthly(spark, sf_dir))[1]


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily WHERE indicator_id = '2-HIGH' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def source_panel_parquet(spark, sf_dir):
    path = folder(spark, "panel")
    orders_daily(spark, sf_dir).write.parquet(path)
    return R.panel_parquet(spark, path, ["2-HIGH"], "1997-01-01", "1998-06-30")


@query(f"WITH {ORDERS_DAILY} SELECT 'GDP' AS indicator_id, date, value FROM orders_daily WHERE indicator_id = '1-URGENT' AND day(date) % 5 <> 0")
def source_observations_json(spark, sf_dir):
    o = orders_daily(spark, sf_dir).where("indicator_id = '1-URGENT'")
    rows = o.select(F.col("date").cast("string").alias("date"), F.when(F.dayofmonth("date") % 5 == 0, ".").otherwise(F.col("value").cast("string")).alias("value"))
    return R.observations_json(spark, _json(rows, folder(spark, "obs"), "observations"), "GDP")


@query(f"WITH {ORDERS_DAILY} SELECT 'ABC' AS indicator_id, date, value FROM orders_daily WHERE indicator_id = '2-HIGH'")
def source_prices_json(spark, sf_dir):
    o = orders_daily(spark, sf_dir).where("indicator_id = '2-HIGH'")
    rows = o.select(F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), (F.col("value") / 2).alias("close"), F.col("value").alias("adjClose"))
    return R.prices_json(spark, _json(rows, folder(spark, "prices")), "ABC")


@query("SELECT DISTINCT date_trunc('second', ts) AS time, user_id::DOUBLE AS latitude, value AS longitude, 10.0::DOUBLE AS depth, round(value / 100, 4) AS mag FROM events WHERE event_type = 'purchase'")
def source_quakes_csv(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("user_id").alias("latitude"), F.col("value").alias("longitude"), F.lit(10.0).alias("depth"), F.round(F.col("value") / 100, 4).alias("mag"))
    a, b = folder(spark, "quakes"), folder(spark, "quakes")
    W.export_csv(e, a)
    W.export_csv(e.where("latitude % 2 = 0"), b)  # pieces that overlap
    return R.quakes_csv(spark, [a, b])


@query(f"WITH {NATION_MONTHLY} SELECT 'cases_' || indicator_id AS indicator_id, date, value FROM nation_monthly WHERE indicator_id IN (SELECT n_name FROM nation WHERE n_nationkey < 3)")
def source_regions_csv(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 3").select("n_name")
    path = folder(spark, "regions")
    W.export_csv(nation_monthly(spark, sf_dir).select(F.col("indicator_id").alias("location"), "date", F.col("value").alias("cases"), F.lit(1).alias("deaths")), path)
    return R.regions_csv(spark, path, "cases", [r["n_name"] for r in n.collect()])


@query("""WITH w AS (SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS sunday, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) SELECT 'wili_nat' AS indicator_id, sunday AS date, v AS value FROM w""")
def source_epiweek_json(spark, sf_dir):
    day = F.to_date("o_orderdate")
    w = table(spark, sf_dir, "orders").groupBy(F.date_sub(day, F.dayofweek(day) - 1).alias("sunday")).agg(F.round(F.sum("o_totalprice"), 2).alias("wili"))
    rows = w.select(F.lit("nat").alias("region"), P.date_to_epiweek(F.col("sunday")).alias("epiweek"), "wili")
    again = rows.where("epiweek % 4 = 0").select("region", "epiweek", F.lit(-1.0).alias("wili"))  # sent twice: the first counts
    rows = rows.withColumn("at", F.lit(0)).unionByName(again.withColumn("at", F.lit(1)))
    return R.epiweek_json(spark, _json(rows.select("region", "epiweek", "wili", "at"), folder(spark, "epi"), "epidata", "at"))


_ONE = "oy AS (SELECT date, value FROM nation_monthly WHERE indicator_id = (SELECT min(n_name) FROM nation))"


def _yearly(spark, sf_dir, missing: str, separator: str):
    first = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("indicator_id"))
    one = nation_monthly(spark, sf_dir).join(F.broadcast(first), "indicator_id")
    cells = [F.coalesce(F.max(F.when(F.month("date") == m, F.round(F.col("value") / 100000, 3).cast("string"))), F.lit(missing)) for m in range(1, 13)]
    return one.groupBy(F.year("date").alias("y")).agg(F.concat_ws(separator, F.first(F.year("date").cast("string")), *cells).alias("value")).select("value")


@query(f"WITH {NATION_MONTHLY}, {_ONE} SELECT 'ONI' AS indicator_id, date, round(value / 100000, 3) AS value FROM oy")
def source_year_by_month(spark, sf_dir):
    path = folder(spark, "noaa")
    _yearly(spark, sf_dir, "-99.90", "  ").write.text(path)
    return R.year_by_month(spark, path, "ONI", low=None, high=None, missing="-99.90")  # totals have no bound; no number is written with that last zero


@query(f"WITH {NATION_MONTHLY}, {_ONE} SELECT 'GISS' AS indicator_id, date, round(round(value / 100000, 3) * 0.01, 6) AS value FROM oy")
def source_anomalies_csv(spark, sf_dir):
    path = folder(spark, "giss")
    _yearly(spark, sf_dir, "***", ",").write.text(path)
    return rounded(R.anomalies_csv(spark, path, "GISS", 0.01))


@query("SELECT 'ENSO' AS indicator_id, make_date(year(o_orderdate), CAST(month(o_orderdate) AS INTEGER), 1) AS date, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 2")
def source_seasonal_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    names = F.array(*[F.lit(s) for s in R.SEASONS])
    path = folder(spark, "oni")
    o.select(F.concat_ws(" ", F.get(names, F.col("m") - 1), F.col("y").cast("string"), F.lit("0.1"), F.col("v").cast("string")).alias("value")).write.text(path)
    return R.seasonal_text(spark, path, "ENSO")


@query(f"WITH {ORDERS_DAILY} SELECT 'CO2' AS indicator_id, date, value FROM orders_daily WHERE indicator_id = '3-MEDIUM' AND day(date) % 4 <> 0")
def source_decimal_dates(spark, sf_dir):
    o = orders_daily(spark, sf_dir).where("indicator_id = '3-MEDIUM'")
    path = folder(spark, "co2")
    value = F.when(F.dayofmonth("date") % 4 == 0, F.lit("-99.99")).otherwise(F.col("value").cast("string"))
    rows = o.select(F.concat_ws("  ", F.year("date").cast("string"), F.month("date").cast("string"), F.dayofmonth("date").cast("string"), F.lit("0.5"), value).alias("value"))
    rows.unionByName(spark.createDataFrame([("# a comment",)], "value string")).write.text(path)
    return R.decimal_dates(spark, path, "CO2", (0, 1, 2), 4)


@query(f"WITH {ORDERS_DAILY} SELECT 'FLOW' AS indicator_id, date, value FROM orders_daily WHERE indicator_id = '4-NOT SPECIFIED' AND day(date) % 6 <> 0")
def source_streamflow_json(spark, sf_dir):
    o = orders_daily(spark, sf_dir).where("indicator_id = '4-NOT SPECIFIED'")
    rows = o.select(F.when(F.dayofmonth("date") % 6 == 0, "-999999").otherwise(F.col("value").cast("string")).alias("value"), F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000")).alias("dateTime"))
    inner = rows.agg(F.collect_list(F.struct("value", "dateTime")).alias("value"))
    whole = inner.select(F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct("value")).alias("values"))).alias("timeSeries")).alias("value"))).alias("value"))
    path = folder(spark, "flow")
    whole.coalesce(1).write.text(path)
    return R.streamflow_json(spark, path, "FLOW")


@query(f"""WITH {ORDERS_DAILY} SELECT indicator_id, CASE indicator_id WHEN '9-BROKEN' THEN 'failed' ELSE 'ok' END AS status, n FROM (SELECT indicator_id, count(*) AS n FROM orders_daily WHERE indicator_id IN ('1-URGENT', '2-HIGH') GROUP BY 1 UNION ALL SELECT '9-BROKEN', 0)""")
def source_ingest(spark, sf_dir):
    path = folder(spark, "ingest")
    of = lambda i: (lambda: orders_daily(spark, sf_dir).where(F.col("indicator_id") == i))
    broken = lambda: orders_daily(spark, sf_dir).where("indicator_id = '3-MEDIUM'").withColumn("value", F.raise_error(F.lit("broken"))).withColumn("value", F.col("value").cast("double"))  # noqa: E731 - fails when it is read, not before
    jobs = {"1-URGENT": of("1-URGENT"), "2-HIGH": of("2-HIGH"), "9-BROKEN": broken}
    R.ingest(spark, {"1-URGENT": of("2-HIGH")}, path=path)  # an older state, which the next run replaces
    got, log = R.ingest(spark, jobs, path=path)
    counts = got.groupBy("indicator_id").agg(F.count("*").alias("n"))
    return log.join(counts, "indicator_id", "left").select("indicator_id", "status", F.coalesce("n", F.lit(0)).alias("n"))


# ---- sinks


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, CASE WHEN indicator_id = '1-URGENT' THEN value * 2 ELSE value END AS value FROM orders_daily")
def sink_replace_partitions(spark, sf_dir):
    path = folder(spark, "replace")
    o = orders_daily(spark, sf_dir)
    W.replace_partitions(o, path, ["indicator_id"])
    W.replace_partitions(o.where("indicator_id = '1-URGENT'").withColumn("value", F.col("value") * 2), path, ["indicator_id"])
    return spark.read.schema("date date, value double, indicator_id string").parquet(path).select("indicator_id", "date", "value")


@query(f"WITH {ORDERS_DAILY} SELECT indicator_id, date, CASE WHEN day(date) % 3 = 0 THEN -value ELSE value END AS value FROM orders_daily UNION ALL SELECT 'new', DATE '2030-01-01', 1.0")
def sink_upsert(spark, sf_dir):
    o = orders_daily(spark, sf_dir)
    new = o.where(F.dayofmonth("date") % 3 == 0).withColumn("value", -F.col("value"))
    new = new.unionByName(spark.createDataFrame([("new", 1.0)], "indicator_id string, value double").withColumn("date", F.lit("2030-01-01").cast("date")))
    return W.upsert(o, new, ["indicator_id", "date"])


@query(f"WITH {EVENTS_HOURLY} SELECT indicator_id, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT * FROM events_hourly UNION ALL SELECT * FROM events_hourly WHERE indicator_id = 'click') GROUP BY 1")
def sink_append(spark, sf_dir):
    path = folder(spark, "append")
    e = events_hourly(spark, sf_dir)
    W.append(e, path)
    W.append(e.where("indicator_id = 'click'"), path)
    return rounded(spark.read.schema(e.schema).parquet(path).groupBy("indicator_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query(f"WITH {ORDERS_DAILY} SELECT * FROM orders_daily WHERE value > 100000")
def sink_exports(spark, sf_dir):
    a, b = folder(spark, "csv"), folder(spark, "json")
    o = orders_daily(spark, sf_dir).where("value > 100000")
    W.export_csv(o, a)
    W.export_json(o, b)
    read = spark.read.schema("indicator_id string, date date, value double")
    return read.csv(a, header=True).intersect(read.json(b))  # both hold every row


@query(f"WITH {ORDERS_DAILY}, d AS (SELECT *, CASE WHEN day(date) = 1 THEN NULL ELSE value END AS v FROM orders_daily) SELECT indicator_id AS dimension, count(*) AS n_skipped FROM d WHERE v IS NULL GROUP BY 1")
def sink_skipped(spark, sf_dir):
    d = orders_daily(spark, sf_dir).select(F.col("indicator_id").alias("dimension"), F.when(F.dayofmonth("date") != 1, F.col("value")).alias("value"))
    return W.valid_only(d)[1]


@query(f"WITH {ORDERS_DAILY} SELECT date, " + ", ".join(f"max(value) FILTER (WHERE indicator_id = '{p}') AS \"{p}\"" for p in TWO) + " FROM orders_daily GROUP BY 1")
def plot_frame(spark, sf_dir):
    return W.plot_frame(orders_daily(spark, sf_dir), TWO)
