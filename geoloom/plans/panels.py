"""Panels on the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_daily(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("indicator_id"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def ship_daily(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("indicator_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


def nation_monthly(spark, sf_dir) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy(F.col("n_name").alias("indicator_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def events_hourly(spark, sf_dir) -> DataFrame:
    """``date`` is the hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("indicator_id"), F.date_trunc("hour", "ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("value"))


def events_by_user(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("indicator_id"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("value"))


ORDERS_DAILY = "orders_daily AS (SELECT o_orderpriority AS indicator_id, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
SHIP_DAILY = "ship_daily AS (SELECT l_returnflag AS indicator_id, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2)"
NATION_MONTHLY = "nation_monthly AS (SELECT n_name AS indicator_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
EVENTS_HOURLY = "events_hourly AS (SELECT event_type AS indicator_id, date_trunc('hour', ts) AS date, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)"
EVENTS_BY_USER = "events_by_user AS (SELECT CAST(user_id AS VARCHAR) AS indicator_id, CAST(ts AS DATE) AS date, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)"
